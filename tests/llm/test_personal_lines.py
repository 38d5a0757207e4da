"""The tagger on lines that its generator didn't make, and its exact decoding of whole texts."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from spectrafold.llm import pii  # noqa: E402

#: (line, what is personal in it): written by hand.
LINES = [
    ("Please call Maria on (415) 555-0134 before noon.", ["(415) 555-0134"]),
    ("Her office line is 212-555-0187, ask for Dr. Hall.", ["212-555-0187"]),
    ("tel (020) 794-6095 or fax (020) 794-6096", ["(020) 794-6095", "(020) 794-6096"]),
    ("Customer: Jan Novak, phone 603-555-1212, Prague", ["603-555-1212"]),
    ("call back at 800-555-0199 ext 4", ["800-555-0199"]),
    ("My number is (312) 867-5309. Thanks!", ["(312) 867-5309"]),
    ("emergency contact 617-555-0110 (sister)", ["617-555-0110"]),
    ("Write to jane.doe@example.com or ring +44 20 7946 0958.", ["jane.doe@example.com", "+44 20 7946 0958"]),
    ("Paid with 4111 1111 1111 1111 at the till", ["4111 1111 1111 1111"]),
    ("login from 192.168.10.44 at 10:22", ["192.168.10.44"]),
    ("The meeting of 12.04.2021 was moved to 03.05.2021.", []),
    ("ISBN 978-3-16-148410-0, second edition", []),
    ("Version 2.14.7 replaces 2.13.11; see ticket #48213.", []),
    ("It cost $1,299.99 in 2019 and 1,450.00 in 2021.", []),
    ("The river is 1,234 km long and 300 m wide at km 57.", []),
    ("Between 1914 and 1918, 40 of 52 weeks were wet.", []),
    ("commit 3f786850e387550fdab836ed7e6dc881de23001b", []),
    ("Order 20240117 shipped on 2024-01-19 at 08:45", []),
    ("@nobody replied to @someone about 5% of it", []),
    ("Room 101, floor 3, building 12-14, zip 90210", []),
    ("pi is 3.14159 and e is 2.71828", []),
    ("scores were 21-14, 7-0 and 3-3 in 1999", []),
    ("temperatures of 10, 12, 15 and 20 degrees", []),
    ("No digits stand in this line at all.", []),
]


def test_held_out_lines():
    model = pii.trained()
    found = pii.model_spans([t for t, _ in LINES], model)
    right = wrong = missed = 0
    for (text, wanted), model_spans in zip(LINES, found, strict=True):
        base = pii.base_spans(text)
        got = [text[a:b] for a, b, _ in base + pii.apart(model_spans, base)]
        right += len(set(got) & set(wanted))
        wrong += len(set(got) - set(wanted))
        missed += len(set(wanted) - set(got))
    print(f"precision {right / (right + wrong):.2f} recall {right / (right + missed):.2f}")
    assert right / (right + wrong) >= 0.85 and right / (right + missed) >= 0.85


def plain(reader, text):
    """Best tags by Viterbi over the whole text at once, no place taken for certain."""
    pieces, classes = [], {0: pii.encoded(text)}
    for group, _ in pii._grouped([text]):
        pieces += group
    s, _, _ = reader._merged(pieces, classes)
    n = np.array([len(text)])
    return pii.viterbi(s, np.array([0]), n, np.array([-1]), np.array([-1]), reader.move), s


def test_decoding_in_stretches_is_exact(monkeypatch):
    rng = np.random.default_rng(5)
    reader = pii.Reader(pii.trained(60))  # little training, so that much is in doubt
    for _ in range(30):
        text = "".join(pii.example(rng)[0] for _ in range(rng.integers(1, 12)))
        path, s = plain(reader, text)
        above = (s[:, 1:].max(1) - s[:, 0]).astype(float)
        sure = reader.outside(above, np.array([0, len(text)]))
        assert not path[sure].any()
    texts = ["".join(pii.example(rng)[0] for _ in range(rng.integers(0, 40))) for _ in range(40)]
    whole = dict(reader.read(texts))
    monkeypatch.setattr(pii, "GROUP", 1000)
    assert dict(reader.read(texts)) == whole and [k for k, _ in reader.read(texts)] == list(range(40))
    assert [dict(reader.read([t]))[0] for t in texts] == list(whole.values())
    monkeypatch.setattr(pii, "PIECE", 200)
    assert len(dict(reader.read(["", "a", "9" * 5000, "1 " * 3000]))) == 4


def test_tables_of_numbers_take_little_memory():
    import tracemalloc

    text = "12 3456.78 (99) 100-2000 " * 16_000  # 400,000 characters
    reader = pii.Reader(pii.trained())
    tracemalloc.start()
    list(reader.read([text]))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 150_000_000


def test_both_directions_take_one_step_together(monkeypatch):
    """A place takes two calls for all its gates and cells, and scores are those of the plain model."""
    model = pii.trained(60)
    rows = np.random.default_rng(3).integers(0, pii.CLASSES - 1, (40, 70)).astype(np.uint8)
    calls = []
    for name in ("exp", "tanh"):
        monkeypatch.setattr(np, name, lambda *a, f=getattr(np, name), **b: (calls.append(1), f(*a, **b))[1])
    total, above = pii.Reader(model).scores(rows)
    assert len(calls) == 2 * len(rows)
    monkeypatch.undo()
    right, _ = model.scores(rows.T.astype(np.int64))
    assert np.abs(total - right).max() < 1e-3
    assert np.abs(above - (right[:, :, 1:].max(2) - right[:, :, 0])).max() < 1e-3
    rows[20] = pii.CLASSES - 1  # where a window ends, both directions start afresh
    parts = [pii.Reader(model).scores(np.ascontiguousarray(x))[0] for x in (rows[:20], rows[21:])]
    cut = pii.Reader(model).scores(rows)[0]
    assert np.abs(cut[:, :20] - parts[0]).max() < 1e-4 and np.abs(cut[:, 21:] - parts[1]).max() < 1e-4
