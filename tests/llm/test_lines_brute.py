"""Line de-duplication against plain Python that compares all pairs of lines."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from semspace.llm import lines
from semspace.llm.common import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    "read more here\nfirst line of its own\nx\nPage 12 of the whole report",
    "READ  more here\nx\ny\npage 13 of the whole report\none two three four five six seven eight",
    "read more hero\nread more  here and there\none two three four five six seven",
    "read more here and theres\none two three four five six seven eight nine\n12345\n12346",
    "one two three 4 five six seven eight\nétude numéro un à jouer\n\n \t ",
    "étude numero un à jouer\n12345\none two three four five six seven nine eight",
    "a b c d e f g h i j k l\na b c d e f g h i j k\na b c d e f g h i j l k\nread\tmore here and there",
]


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), len(x))
    return x[i + (len(x) == len(y)):] == y[i + 1:]


def plain(texts):
    """{(doc, line)} that go; texts by doc_id."""
    first, places = {}, []
    for doc, text in enumerate(texts):
        for number, line in enumerate((text or "").split("\n")):
            words = tuple(WORD.findall(line.translate(LOWER)))
            if words:
                places.append((doc, number, words))
                first.setdefault(words, (doc, number))
    gone = set()
    units = {w: (True, w) if len(w) >= lines.NEAR_WORDS else (False, " ".join(w)) for w in first}
    for w, at in first.items():
        long, u = units[w]
        if not long and len(u) < lines.NEAR_CHARS:
            continue
        if any(other < at and units[x][0] == long and (long or len(units[x][1]) >= lines.NEAR_CHARS) and near(u, units[x][1])
               for x, other in first.items()):
            gone.add(w)
    return {(d, n) for d, n, w in places if w in gone or (d, n) > first[w]}


def removed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.doc_id, r.line) for r in lines.removed_lines(docs).collect()]


def test_lines_of_every_length(spark):
    got = removed(spark, TEXTS)
    assert len(got) == len(set(got)) and set(got) == plain(TEXTS)
    assert (1, 0) in got and (1, 1) in got and (1, 3) in got and (3, 3) not in got and (5, 0) in got


def test_real_documents(spark):
    texts = [r.text for r in documents(spark, "/root/testdata/sf0.001").orderBy("doc_id").limit(150).collect()]
    assert set(removed(spark, texts)) == plain(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=5), st.lists(st.integers(0, 2), max_size=5)), min_size=1, max_size=6))
def test_one_edit(pairs):
    import pyarrow as pa

    x, y = (pa.array([p[i] for p in pairs], pa.list_(pa.int64())) for i in (0, 1))
    assert lines._within_one(x, y).tolist() == [near(a, b) for a, b in pairs]


@pytest.mark.parametrize("hot", [1, 4096])
def test_hot_lines_change_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT_LINES", hot)
    assert set(removed(spark, TEXTS * 3)) == plain(TEXTS * 3)
