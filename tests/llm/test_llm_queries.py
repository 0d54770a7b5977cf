"""The registered queries: against their SQL, or against a plain restatement on the smallest tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import queries as Q

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(name, same_as_sql):
    same_as_sql(Q.queries()[name], Q.oracle_sql()[name])


@pytest.fixture(scope="module")
def documents(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_op7(spark, small, documents):
    sets = {i: shingles(t) for i, t in documents.items()}
    expected = components(sets)
    rows = Q.op7_ngram_jaccard_join(spark, small).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (len(s), expected[i]) for i, s in sets.items()}
    assert len(rows) == len(documents)


def test_op2(spark, small, documents):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    for r in Q.op2_byte_bpe(spark, small).collect():
        ids = library.encode_ordinary(documents[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == digest(",".join(map(str, ids)).encode())
        assert r["decoded_sha256"] == digest((documents[r["doc_id"]] or "").encode())


@pytest.fixture(scope="module")
def encoded(documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in documents.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op4(spark, small, encoded):
    before = 0
    rows = {r["doc_id"]: r for r in Q.op4_token_files(spark, small).collect()}
    for i in sorted(encoded):
        ids = [*encoded[i], 2]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (before, len(ids), crc(ids))
        before += len(ids)
    assert len(rows) == len(encoded)


def packing_holds(rows, encoded, window=1024):
    by_doc, by_sequence = {}, {}
    for r in rows:
        ids = [*encoded[r["doc_id"]], 0]
        assert r["doc_tokens"] == len(ids) and r["length"] > 0
        assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, ids in encoded.items():
        at = 0
        for start, n in sorted(by_doc[i]):
            assert start == at
            at += n
        assert at == len(ids) + 1
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return padding


def test_op10(spark, small, encoded):
    assert packing_holds(Q.op10_packing(spark, small).collect(), encoded) == 0


def test_op1_returns_every_document_once(spark, small, documents):
    rows = {r["doc_id"]: r for r in Q.op1_substring_dedup(spark, small).collect()}
    assert rows.keys() == documents.keys()
    for i, r in rows.items():
        if r["n_removed_words"] == 0:
            assert r["text"] == documents[i]
            assert r["class_id"] == i
        assert r["n_words"] - r["n_removed_words"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))


def test_op9_recovers_roles(spark, small, duck):
    truth = {(c, t): r for c, t, r in duck.sql("SELECT conv_id, turn, role FROM conversations").fetchall()}
    rows = Q.op9_chat_format(spark, small).collect()
    right = sum(r["first_line"] == 0 and truth.get((r["conv_id"], r["first_turn"])) == r["role"] for r in rows)
    assert right / len(rows) > 0.9 and right / len(truth) > 0.9


def test_pipeline(spark, small, documents):
    """Each stage on what the one before it kept."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, small), name.replace(" ", "-"))
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in Q.op6_quality_rules(spark, small).collect() if r["kept"]}
    assert kept["quality rules"] == {i: documents[i] for i in good}
    assert kept["line dedup"].keys() == good
    groups = components({i: shingles(t) for i, t in kept["line dedup"].items()})
    assert kept["n-gram Jaccard join"].keys() == {i for i, c in groups.items() if i == c}
    assert kept["substring dedup"].keys() == kept["n-gram Jaccard join"].keys()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in kept["substring dedup"].items()}
    assert packing_holds(P.STAGES[-1][1](spark, docs, small).collect(), ids) == 0


def test_pipeline_stages_on_odd_rows(spark, small):
    """Nulls in any column, empty texts, repeated rows and ids, no rows, and columns named as the operators' own."""
    import random

    import corpus_pipeline as P

    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    one, two = prose(60), prose(80)
    lines = "\n".join(prose(7) for _ in range(40))
    rows = [(1, one, "en", "s", 3, 0), (1, one, "en", "s", 3, 0), (2, one, None, None, None, None), (None, two, "en", "s", 1, 1), (None, None, None, None, None, None)]
    rows += [(3, None, "en", "s", 0, 2), (4, "", "en", "s", 0, 2), (5, two, "en", "s", 9, 3), (5, prose(70), "en", "s", 9, 3), (6, lines, "en", "s", 1, 1), (7, prose(20) + "\n" + lines, "en", "s", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id int")
    for start in (docs, docs.limit(0)):
        current = start
        for name, stage in P.STAGES[:-1]:
            current = P.stored(stage(spark, current, small), name.replace(" ", "-"))
            assert current.columns == docs.columns
        left = sorted(((r["doc_id"], r["text"]) for r in current.collect()), key=repr)
        pieces = P.STAGES[-1][1](spark, current, small).collect()
        if start is docs:
            # two equal rows of one id are one document, and its copy goes; texts without words fail the rules
            assert [x for x in left if x[0] in (1, 2)] == [(1, one)] * 2 and (None, two) in left
            assert not {3, 4} & {i for i, _ in left} and sum(i == 5 for i, _ in left) == 2
            assert dict(left)[6] == lines and len(dict(left)[7]) < 700
            assert {r["doc_id"] for r in pieces} == {i for i, _ in left}
        else:
            assert left == [] and pieces == []
