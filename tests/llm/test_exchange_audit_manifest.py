"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables
and columns whose names clash with the operators' own."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from semspace.llm import audit, fingerprints, merkle

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, digest string, row string, mask int, n int, "
        "size int, part string, tree string, id int, pos int, word int, norm string, chunk int, owner int")
CLASH = ("d", "r", 1, 2, 3, "p", "t", 4, 5, 6, "x", 7, 8)
LONG = " ".join(f"w{i % 50_000}" for i in range(70_000))
WORDS = "one two three four five six seven eight nine ten"
ROWS = [
    (1, WORDS, "en", "a", 3), (2, WORDS.replace(" ", "\n "), "en", "a", 3), (3, WORDS, "fr", None, None), (3, WORDS, "fr", None, None),
    (4, None, None, "a", 0), (5, "", "", "a", 0), (6, " \t\n\r\x0b\x0c", "en", None, 4), (None, WORDS, "en", "c", 1), (None, WORDS + "  ", None, "c", 1),
    (7, LONG, "fr", "a", 1), (8, LONG, "fr", "a", 1), (9, "A " * 120, "de", "c", 7), (10, "# " + " ".join(f"x{i}" for i in range(130)), "de", "c", 7),
    (11, "-", "-", "-", 1), (12, "é" * 3 + " É", "é", "ß", 5), (13, "ABC def", "EN", "a", 7), (14, " ".join(f"Y{i}" for i in range(130)), "de", "c", 7),
]
LABELS = [(1, 1, 0), (2, 0, 1), (7, 1, 1), (8, 1, None), (9, None, 1), (10, 1, 0), (10, 0, 1), (None, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *CLASH) for r in ROWS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# -- operator 11 --------------------------------------------------------------------------------------

def best_of(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    want = []
    for norm, members in groups.items():
        members.sort()
        for at, m in enumerate(members):
            want.append((str(m[3]), str(members[0][3]), len(members), at == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return Counter(want)


def rows_of(df):
    return Counter((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_exact_groups(docs, none):
    assert rows_of(fingerprints.exact_groups(docs)) == best_of(ROWS)
    assert fingerprints.exact_groups(none).count() == 0
    assert fingerprints.deduplicated(none).count() == 0
    kept = fingerprints.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == [
        "10", "11", "12", "13", "14", "2", "6", "7", "9"]


@pytest.mark.parametrize("chunk_rows", [1, 7, 1 << 18])
def test_exact_groups_random(spark, chunk_rows):
    rng = np.random.default_rng(chunk_rows)
    rows = [(int(i), "".join(rng.choice(list("ab \n"), rng.integers(0, 7)))) for i in rng.permutation(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprints.labelled(df, chunk_rows=chunk_rows).withColumn("text_sha256", F.lower(F.hex("digest")))
    assert rows_of(got) == best_of(rows)


def test_weak_digests_are_told_apart_by_bytes(spark):
    rows = [(i, " " * (i % 3) + "xyz"[i % 3: i % 3 + 1] * (1 + i % 5)) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.labelled(df, digest=lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 0))
    want = {(d, k, n, kept) for (d, k, n, kept, _) in best_of(rows)}
    assert {(str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got.collect()} == want and got.count() == 61


def test_golomb_round_trip():
    rng = np.random.default_rng(5)
    for span, n in ((1, 1), (2, 2), (1000, 1000), (1 << 20, 500), (1 << 40, 64), (1 << 30, 1)):
        values = np.unique(rng.integers(0, span, n))
        for low in {0 if span < 5000 else 12, fingerprints.rice_bits(span, len(values))}:
            code = fingerprints.golomb_encode(values, low)
            assert (fingerprints.golomb_decode(code, len(values), low) == values).all()
    values = np.unique(rng.integers(0, 1 << 34, 1 << 16))
    code = fingerprints.golomb_encode(values, fingerprints.rice_bits(1 << 34, len(values)))
    assert len(code) * 8 / len(values) < 34 - 16 + 2.1


# -- operator 12 --------------------------------------------------------------------------------------

def brute_audit(rows, labels):
    texts = defaultdict(list)
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            texts[text or ""].append(doc_id)
    docs = []
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": doc_id is not None and any(i < doc_id for i in texts[t])}
        mine = [x for x in labels if doc_id is not None and x[0] == doc_id]
        docs.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            alive = own
            for at, f in enumerate(order):
                gone = [d for d in alive if d[1][f]]
                alive = [d for d in alive if not d[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), at + 1] = [
                    len(alive), len(gone), sum(d[1][f] for d in own) - len(gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in own),
                    sum(d[2] for d in gone), sum(d[3] for d in gone), f]
        for key, value in out.items():
            if key[0] == part:
                value[6] = shapley[value[6]]
    return out


def test_filter_audit(spark, docs, none):
    labels = spark.createDataFrame([(*x, "z") for x in LABELS], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
           for r in audit.filter_audit(docs, labels).collect()}
    assert got == brute_audit(ROWS, LABELS)
    assert audit.filter_audit(none, labels).count() == 0
    assert audit.filter_audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_counters_do_not_overflow(spark):
    big = (1 << 40) + 12345
    counted = spark.createDataFrame([("p", 3, 1, 0, big), ("p", 3, 0, 1, big), ("p", 0, 0, 0, 255), ("q", 1, 0, 0, 1)],
                                    "part string, mask int, good int, toxic int, n long")
    got = {(r.part, r.filter_order, r.step): r for r in audit.audit(counted, "AB").collect()}
    assert len(got) == 8
    assert got["p", "AB", 1].removed == 2 * big and got["p", "AB", 1].kept == 255 and got["p", "AB", 2].redundant == 2 * big
    assert got["p", "BA", 1].good_lost == big and got["p", "BA", 1].toxic_lost == big and got["p", "AB", 1].unique_fails == 0
    assert got["p", "AB", 2].shapley == 2 * big and got["q", "BA", 2].removed == 1 and got["q", "BA", 2].unique_fails == 1


def test_many_parts_flush(spark, monkeypatch):
    monkeypatch.setattr(audit, "PARTS_HELD", 3)
    counted = spark.range(200).selectExpr("cast(id % 20 as string) part", "cast(id % 8 as int) mask", "0 good", "0 toxic", "1L n")
    got = audit.audit(counted, "ABC").groupBy("part").agg(F.count("*").alias("c"), F.max(F.expr("kept + removed")).alias("m")).collect()
    assert {(r.c, r.m) for r in got} == {(18, 10)} and len(got) == 20


# -- operator 13 --------------------------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(doc_id, text, lang, source, n_chars):
    def one(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return sha(*(one(v) for v in (doc_id, source, lang, n_chars, text)))


def collapse(nodes, at):
    """Top, the siblings of ``at`` level by level as (left, right)."""
    path = []
    while len(nodes) > 1:
        run, slot = nodes[at // 8 * 8: at // 8 * 8 + 8], at % 8
        path.append((run[:slot], run[slot + 1:]))
        nodes, at = [sha(*nodes[i: i + 8]) for i in range(0, len(nodes), 8)], at // 8
    return nodes[0], path


def brute_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, brute_leaf(*r[:5]), r))
    keys = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        trees[k].sort(key=lambda x: x[:3])
    subroots = [collapse([x[2] for x in trees[k]], 0)[0] for k in keys]
    out = Counter()
    for at, k in enumerate(keys):
        root, above = collapse(subroots, at)
        for i, (_, _, leaf, r) in enumerate(trees[k]):
            _, path = collapse([x[2] for x in trees[k]], i)
            value = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                value = brute_leaf(r[0], re.sub("[A-Z]", lambda m: m[0].lower(), r[1]), *r[2:5])
            for left, right in path + above:
                value = sha(*left, value, *right)
            proof = sha(*(x for left, right in path + above for x in left + right))
            out[str(r[0]), leaf, subroots[at], root, proof, value, value == root] += 1
    return out


def manifest_rows(df):
    return Counter((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
                   for r in merkle.document_manifest(df).collect())


def test_manifest(spark, docs, none):
    assert manifest_rows(docs) == brute_manifest(ROWS)
    assert merkle.document_manifest(none).count() == 0
    one = docs.where("doc_id = 7")
    assert manifest_rows(one) == brute_manifest([ROWS[9]])


@pytest.mark.parametrize("langs", [1, 75])
def test_manifest_of_several_rounds(spark, langs):
    sizes = [4700, 512, 513, 9, 8, 1] if langs == 1 else [1] * 75
    rows = [(int(i) if i % 97 else None, f"Text {i % 13}", f"l{k}", "s", i) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    assert manifest_rows(df) == brute_manifest(rows)


def test_states_resume_without_the_left_siblings():
    run = [sha(str(i)) for i in range(8)]
    states = merkle.retained(run)
    for slot in range(8):
        assert merkle.resumed(states[slot], "new", "".join(run[slot + 1:])) == sha(*run[:slot], "new", *run[slot + 1:])
        assert merkle.resumed(states[slot], run[slot], "".join(run[slot + 1:])) == sha(*run)
