from hypothesis import given
from hypothesis import strategies as st

from weirflow.functions import text as X


def test_chunks():
    assert X.chunks("") == [] == X.chunks(None) == X.chunks("  \n ")
    assert X.chunks("short") == ["short"]
    parts = X.chunks("\n\n".join(f"{i}" * 60 for i in range(9)), 100, 10)
    assert len(parts) == 9 and parts[1] == "0" * 10 + "1" * 60
    assert X.split_pieces("x" * 250, 100) == ["x" * 100, "x" * 100, "x" * 50]


@given(st.text("ab \n.", max_size=300))
def test_pieces_fit(text):
    assert all(0 < len(p) <= 20 and p.strip() for p in X.split_pieces(text, 20))


def test_chunk_sizes():
    """A text as long as a chunk is one; overlaps are of the piece before, not of its chunk; separators at the cuts go."""
    assert X.chunks("a" * 3200) == ["a" * 3200] and [len(c) for c in X.chunks("a" * 8000)] == [3200, 3600, 2000]
    assert X.split_pieces("one. two. three", 9) == ["one. two", "three"]
    assert X.split_pieces("a\n\nb c d\n\ne", 4) == ["a", "b c", "d", "e"]  # what was cut finer is not merged again
    assert X.split_pieces("\n\nab\n\ncd", 4) == ["ab", "cd"]


def test_strip_commentary():
    assert X.strip_commentary(" no trim without commentary ") == " no trim without commentary "
    assert X.strip_commentary("【commentary a】 rest") == "rest" and X.strip_commentary("a【commentary】b") == "ab"
    assert X.strip_commentary("【" + " " * 40 + "commentary】") == "【" + " " * 40 + "commentary】"
    assert X.strip_commentary("plain 【1】 text ") == "plain 【1】 text "
    assert X.strip_commentary("a 【commentary x【y】z】 b") == "a b"
    assert X.strip_commentary("a 【 Commentary never closed") == "a"


_PIECES = st.lists(st.text("【】 acommentry\n", max_size=12), max_size=12)


@given(_PIECES)
def test_stream_equals_batch(pieces):
    f = X.CommentaryFilter()
    got = "".join(f.push(p) for p in pieces) + f.flush()
    want = X.strip_commentary("".join(pieces))
    assert got.lstrip() == want.lstrip()


def test_stream_comes_out_at_once():
    f = X.CommentaryFilter()
    assert f.push("so far ") == "so far" and f.push("【comm") == "" and f.push("entary long ") == ""
    assert (f.held, f.undecided, f.depth) == (" ", "", 1)
    assert f.push("x" * 10_000) == "" and f.push("】 on 【1】") == " on 【1】" and f.flush() == ""


def test_frames():
    frames, rest = X.sse_frames("data: a\n\nevent: x\ndata: b\ndata: c\n\ndata: d")
    assert frames == ["a", "b\nc"] and rest == "data: d"


def test_seeded_order():
    assert X.fnv1a("") == 0x811C9DC5 and X.fnv1a("a") == 0xE40C292C
    first = [X.seeded_order(f"case-{i}", ["x", "y", "z"])[0] for i in range(600)]
    assert all(140 < first.count(v) < 260 for v in "xyz")
    assert X.seeded_order("k", ["x", "y", "z"]) == X.seeded_order("k", ["x", "y", "z"])
