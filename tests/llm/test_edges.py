"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from semspace.llm import jaccard, lines, mixing, neighbours, packing, quality, rules, secrets, separators, tokens, warc
from semspace.llm.common import components

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, row string, size int, score int, id int, "
        "h string, _lines int, rank int, token string, start int")
LONG = " ".join(f"w{i}" for i in range(60_000))
PROSE = "the quick brown fox jumps over the lazy dog near the old river bank today"
ROWS = [
    (1, PROSE + "\n" + PROSE, "en", "b", 10), (2, PROSE + "\n" + PROSE, "en", "b", 10), (3, PROSE.replace("lazy", "idle"), None, None, None),
    (4, None, "en", "a", 0), (5, "", "en", "a", 0), (6, " \t\n ", "en", None, 4), (None, "no id here at all but words", "en", "c", 1),
    (7, LONG, "fr", "a", 1), (8, "one two", "en", "c", 7), (8, "one two", "en", "c", 7), (9, "ONE two", "en", "c", 7),
    (10, "é́ <|endoftext|>. Don't I'll x1y2 naïve… Σίσυφοςς ǅ «quoted».", "en", "c", 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y", 4, 5, "z", 6) for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_jaccard(docs, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert {(1, 15, 1), (2, 15, 1), (3, 12, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (8, 1, 8), (9, 1, 8), (7, 59_997, 7)} <= got
    assert jaccard.jaccard_components(docs).count() == len(ROWS)
    assert jaccard.jaccard_components(none).count() == 0
    kept = jaccard.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "10", "3", "4", "5", "6", "7", "8", "None"]


def test_lines(docs, none):
    got = {tuple(r)[:1] + tuple(r)[2:] for r in lines.removed_lines(docs).collect()}
    assert (1, 1, 15, "equal", 1, 0) in got and (2, 0, 15, "equal", 1, 0) in got and (3, 0, 15, "near", 1, 0) in got
    assert (9, 0, 2, "equal", 8, 0) in got and {g[0] for g in got} == {1, 2, 3, 9}
    assert lines.removed_lines(none).count() == 0
    out = {r.doc_id: r for r in lines.without_removed(docs).collect()}
    assert set(out) == {1, 4, 5, 6, None, 7, 8, 10} and out[1].text == PROSE and out[1].n_chars == len(PROSE)
    assert out[1].asDict().keys() == set(docs.columns) and out[7].text == LONG and out[4].text is None
    assert lines.without_removed(docs).where("doc_id = 8").count() == 2


def test_mixing(docs, none):
    rows = mixing.allocate(mixing.sized(docs, ["doc_id"])).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.copies <= 2 for r in rows)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(none).count() == 0


def test_packing(docs, none):
    pieces = packing.pack(docs).collect()
    encoder = tokens.encoder(tokens.default_path()).tokenizer
    want = sorted(len(encoder.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ROWS)
    assert sum(want) == sum(p.length for p in pieces)
    for r in ROWS:
        if r[0] in (7, 10, 4):
            ids = np.array(encoder.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
            mine = [p for p in pieces if p.doc_id == r[0]]
            assert all(p.doc_tokens == len(ids) and zlib.crc32(ids[p.start: p.start + p.length].tobytes()) == p.ids_crc32 for p in mine)
            assert sum(p.length for p in mine) == len(ids)
    sizes: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sizes.get(p.sequence_id, 0)
        sizes[p.sequence_id] = p.offset + p.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in sizes.values())
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("totals", [{0: 5}, {0: 100_000, 3: 1, 5: 40_000}, {i: 1000 + i for i in range(30)}])
def test_schedule_is_a_partition(totals):
    plan = packing.Schedule(totals, 512)
    queue = np.repeat(list(totals), 3)
    n = np.concatenate([[t // 3, t // 3, t - 2 * (t // 3)] for t in totals.values()])
    start = np.concatenate([[0, t // 3, 2 * (t // 3)] for t in totals.values()])
    use = n > 0
    row, at, length, sequence, offset = plan.pieces(queue[use], start[use], n[use])
    assert length.sum() == sum(totals.values())
    ends: dict = {}
    for s, o, m in sorted(zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True)):
        assert ends.get(s, 0) == o
        ends[s] = o + m
    assert all(m == 512 for s, m in ends.items() if s < plan.full)


def test_quality(docs, none, labels):
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.quality_scores(docs, labels.limit(0)).first().score == 0.5
    assert quality.quality_scores(none, labels).count() == 0
    assert quality.good_documents(docs, labels).columns == docs.columns


def test_rules(docs, none, labels):
    got = {r.doc_id: r for r in rules.judged(docs, labels).collect()}
    assert got[7].n_words == 60_000 and got[4].n_words == 0 and got[4].base_failed and not got[4].kept
    assert got[1].n_dup_lines == 1 and got[1].n_repeat_words == 30
    assert rules.judged(none, labels).count() == 0 and rules.judged(docs, labels.limit(0)).count() == len(ROWS)


def test_separators(docs, none, spark, tmp_path):
    encoder = tokens.encoder(tokens.default_path(), literal=True).tokenizer
    want = sorted((str(r[0]), len(encoder.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    assert sorted((str(r.doc_id), r.n_tokens) for r in separators.token_counts(docs).collect()) == want
    assert separators.token_counts(none).count() == 0
    ids = np.array([9, 9, 5, 9, 1, 1, 1, 1, 1, 1, 1, 9, 3], "<u2")
    (tmp_path / "a.ids").write_bytes(ids.tobytes())
    files = spark.createDataFrame([(str(tmp_path / "a.ids"), 2, len(ids))], "file string, width int, ids long")
    for block in (1, 2, 3, 100):
        got = sorted(tuple(r)[1:] for r in separators.scan(files, str(tmp_path), 9, block).collect())
        assert got == [(0, 0, 0, True), (1, 1, 0, True), (2, 2, 1, True), (3, 4, 7, True), (4, 12, 1, False)]


def test_tokens_equal_whole_texts():
    import pyarrow as pa

    texts = [r[1] for r in ROWS] + ["İstanbul Ǆ a b c d ... ?! x.y, 'tis he'd. <|ENDOFTEXT|> <|endoftext|>Abc. é. 1,2;"]
    encoder = tokens.encoder(tokens.default_path())
    mine = []
    for _, ids, offsets in encoder.rows(pa.array(texts)):
        mine += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert mine == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_secrets(spark, docs, none):
    key = "AKIA" + "B" * 16
    part = "Q" * 39 + "+"
    text = f"é password = 'aaaa' token:abcdefghijkl {key} {part} https://h.example/x 0123456789abcdef"
    far = f"{part} https://h.example/x " + "x " * 500 + key
    got = secrets.secret_scan(spark.createDataFrame([(1, text), (2, far), (3, None), (3, None)], "doc_id long, text string")).collect()
    one = next(r for r in got if r.doc_id == 1)
    base = [f"{k}:{m.start()}:{m.end()}" for k, p in (("assign", "token:[a-l]+"), ("access", "AKIA\\w+"), ("hex", "0123456789abcdef"))
            for m in [re.search(p, text)]]
    assert one.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and one.n_linked == 2
    assert f"weak:{text.index(part)}:{text.index(part) + 40}" in one.spans and "endpoint:" in one.spans
    assert next(r for r in got if r.doc_id == 2).n_linked == 0 and sum(r.doc_id == 3 for r in got) == 2
    assert secrets.secret_scan(docs).count() == len(ROWS) and secrets.secret_scan(none).count() == 0


def test_warc(spark):
    page = "<p>é</p>" * 400_000
    rows = [(1, "u\r\nX: y", page), (2, None, page), (3, "u", None), (4, "u", "a" * 999), (5, "u", "a" * 999), (None, "u", page), (2, None, page)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string")
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(i, len((h or "").encode()), sha(h), "revisit" if i == 1 else "response", 2 if i == 1 else None) for i, _, h in rows]
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0
    a, b = "a" * 1000, "b" * 1000
    again = spark.createDataFrame([(1, "u", a), (1, "u", b), (2, "u", a), (3, "u", b)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_digest, r.refers_to) for r in warc.round_trip(again).collect())
    assert got == sorted([(1, sha(a), 2), (1, sha(b), 3), (2, sha(a), None), (3, sha(b), None)], key=lambda r: r[:2])


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 8))
    rows = [(i, (x[i % 10] + 0.01 * x[i]).tolist(), 1) for i in range(40)] + [(40, x[0].tolist(), None), (41, [0.0] * 8, 1), (42, None, 1),
            (43, [float("nan")] + [1.0] * 7, 1), (44, [], 1), (45, x[0].tolist()[:4], 1), (46, [float("inf")] * 8, 1), (0, (x[0] * 1.01).tolist(), 1)]
    vectors = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, n long")
    got = neighbours.near_duplicates(vectors).collect()
    assert len(got) == len(rows)
    mine = {r.vec_id: r for r in got if r.vec_id}
    assert mine[11].component_id == 1 and not mine[11].kept and all(mine[i].n_links == 0 and mine[i].kept for i in range(40, 47))
    unit = np.array([r[1] for r in rows[:40]])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = (unit @ unit.T >= 0.93).sum(1) - 1
    assert all(mine[i].n_links == near[i] for i in range(1, 10) if i % 10)
    assert neighbours.near_duplicates(vectors.limit(0)).count() == 0
    v, w, u = x[0].tolist(), (x[0] + 0.001 * x[1]).tolist(), (x[0] + 0.001 * x[2]).tolist()
    again = spark.createDataFrame([(0, v, 1), (0, w, 1), (0, v, 1), (5, u, 1), (0, x[3].tolist(), 2), (6, x[3].tolist(), 2)],
                                  vectors.select("vec_id", "embedding", "label").schema)
    got = sorted(tuple(r) for r in neighbours.near_duplicates(again).collect())
    assert got == [(0, 1, 0, True), *[(0, 2, 0, True)] * 3, (5, 2, 0, False), (6, 1, 0, False)]


@pytest.mark.parametrize("n", [300, 3000])
def test_neighbours_find_planted_pairs(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=(n, 64))
    y -= (x * y).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    y = 0.9301 * x + np.sqrt(1 - 0.9301 ** 2) * y
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, y]))]
    got = neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    found = sum(r.n_links > 0 for r in got if r.vec_id < n)
    assert found >= 0.99 * n and all(r.component_id in (r.vec_id, r.vec_id - n) for r in got)
    assert neighbours.tables_for(1 << 16, 0.93) == (42, 16) and neighbours.tables_for(1 << 40, 0.93)[1] == 30


def test_components(spark):
    rows = [(i, i + 1) for i in range(0, 50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (300, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[100 + i] == 100 for i in range(40)) and got[300] == got[200] == 200
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline_on_edges(spark, docs, none, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start in (docs, none):
        table = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, str(tmp_path))
            assert table.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).count()
