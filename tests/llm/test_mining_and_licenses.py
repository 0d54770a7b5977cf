"""Hard negatives against brute force, licence scans against plain restatements."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import hard_negatives as H
from lodestar.llm import license_scan as L

VECTORS = "vec_id long, embedding array<float>, label int, rank int, score string, row long, windows int"


def mined(rows, is_anchor, positives, negatives, low=30, high=90):
    """By brute force, with Python's integers; rows are (id, vector, label)."""
    whole = lambda v: [math.floor(256 * float(x)) for x in v]
    ok = [(i, whole(v), c) for i, v, c in rows if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    out = []
    for i, a, c in ok:
        if not is_anchor(i):
            continue
        others = [(j, dot(a, b), d) for j, b, d in ok if len(a) == len(b)]
        best = sorted((x for x in others if x[2] == c and x[0] != i), key=lambda x: (-x[1], x[0]))[:positives]
        for p, ps, _ in best:
            fit = sorted((x for x in others if x[2] != c and low * ps <= 100 * x[1] <= high * ps), key=lambda x: (-x[1], x[0]))[:negatives]
            out += [(i, p, n + 1, j, clip(ps), clip(s)) for n, (j, s, _) in enumerate(fit)]
    return sorted(out)


def made(spark, rows, every, **settings):
    frame = spark.createDataFrame([(i, v, c, 1, "s", 2, 3) for i, v, c in rows], VECTORS)
    found = H.hard_negatives(frame, F.col("vec_id") % every == 0, **settings)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def some(n, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(0, 0.4, dims)], int(rng.integers(0, 3))) for i in range(n)]


def test_negatives_as_brute_force_in_small_groups(spark):
    """Ties and copies, a vector that a third of all rows share, nulls in every column, a score of zero."""
    rows = some(160)
    shared = [0.3] * 8
    rows += [(1000 + i, shared, i % 3) for i in range(80)]
    rows += [(i, v, c) for i, v, c in some(6, seed=3)]  # repeated rows
    rows += [(2000, None, 1), (2001, [None] * 8, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] * 8, 1), (2004, shared, None), (None, shared, 1), (2006, [0.0] * 8, 0), (2010, [0.0] * 8, 1)]
    expected = mined(rows, lambda i: i % 10 == 0, 3, 4)
    assert made(spark, rows, 10, positives=3, negatives=4, group_rows=60, group_anchors=9) == expected
    assert made(spark, rows, 10, positives=3, negatives=4) == expected


def test_odd_vectors(spark):
    """Other lengths, no components at all, and values whose scores pass 64 bits."""
    rows = some(12) + [(100 + i, [0.1 * i, 0.2], i % 2) for i in range(8)] + [(200 + i, [], i % 2) for i in range(4)]
    rows += [(300 + i, [1e20 * (i + 1)] * 8, i % 3) for i in range(9)] + [(400 + i, [200.0 + i] * 8, i % 3) for i in range(9)]
    assert made(spark, rows, 5, positives=3, negatives=5) == mined(rows, lambda i: i % 5 == 0, 3, 5)


def test_no_rows(spark):
    assert made(spark, [], 10) == []
    assert made(spark, [(7, [1.0], 1)], 10) == []  # no anchor
    assert made(spark, [(10, [1.0], 1), (11, [1.0], 2)], 10) == []  # no positive


def test_bounds_hold_and_leave_few_candidates():
    rng = np.random.default_rng(0)
    rows = np.floor(256 * rng.normal(0, 1 / 8, (4000, 64))).astype(np.int16)
    import pyarrow as pa

    lists = lambda x: pa.chunked_array([pa.array(list(x), pa.list_(pa.int16()))])
    ranges = pa.table({"low": lists([rows.min(axis=0)]), "high": lists([rows.max(axis=0)])})
    edges = np.frombuffer(H._grid(64)((pa.scalar(64),), ranges, pa.table({"small": lists(rows[::10])})).column("edges")[0].as_py(), np.int32).reshape(2, 64, 64)
    codes = np.stack([np.searchsorted(edges[0, 1:, d], rows[:, d], side="right") for d in range(64)], axis=1).astype(np.uint8)
    anchors = rows[:20].astype(float)
    lower, upper = H.bounds(anchors, codes, edges)
    exact = rows.astype(float) @ anchors.T
    assert (lower <= exact).all() and (exact <= upper).all()
    share = []
    for j in range(20):
        low, high = 0.3 * np.sort(exact[:, j])[-2], 0.9 * np.sort(exact[:, j])[-2]
        may = H.window_candidates(lower[:, j], upper[:, j], low, high, -math.inf, 10)
        inside = np.flatnonzero((exact[:, j] >= low) & (exact[:, j] <= high))
        assert may[inside[np.argsort(-exact[inside, j], kind="stable")[:10]]].all()
        share.append(may.mean())
    assert np.mean(share) < 0.1


# Licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, labels int, _others string, `a b` int"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def scan(text, **kw):
    return L.Scanner(kw.get("phrases", {}), kw.get("templates", {})).scan(text.encode())


def accepts(template, text):
    n, spans = scan(text, templates={"x": template})
    return bool(spans) and spans[0][2:] == (0, n)


def expand(template, rng):
    """A text that the template accepts."""
    out, place, skip = [], 0, []
    for mark in L._MARKUP.finditer(template):
        if all(skip):
            out += template[place : mark.start()].split()
        place = mark.end()
        if mark[1] == "beginOptional":
            skip.append(rng.random() < 0.5)
        elif mark[1] == "endOptional":
            skip.pop()
        elif all(skip):
            out += [f"w{rng.randint(0, 9)}" for _ in range(rng.randint(int(mark[2]), int(mark[3])))]
    return out + template[place:].split()


def test_markup():
    assert accepts("a <<beginOptional>>b c<<endOptional>> d", "a d")
    assert accepts("a <<beginOptional>>b c<<endOptional>> d", "A b, C\nD")
    assert not accepts("a <<beginOptional>>b c<<endOptional>> d", "a b d")
    assert not accepts("a <<beginOptional>>b<<endOptional>> d", "a b b d")
    assert accepts("a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d", "a b d")
    assert accepts("a <<var;min=1;max=2>> d", "a x d") and accepts("a <<var;min=1;max=2>> d", "a d d")
    assert not accepts("a <<var;min=1;max=2>> d", "a d") and not accepts("a <<var;min=1;max=2>> d", "a x y z d")
    for wrong in ("<<beginOptional>>a<<endOptional>>", "a <<beginOptional>>b", "a b<<endOptional>>", "a <<var;min=3;max=2>>"):
        with pytest.raises(ValueError):
            L.Automaton(wrong)


def test_every_template_accepts_its_texts_and_only_those():
    rng = random.Random(1)
    for label, template in L.TEMPLATES.items():
        for _ in range(30):
            text = expand(template, rng)
            assert accepts(template, " ".join(text)), (label, text)
            broken = list(text)
            at = rng.choice([i for i, w in enumerate(text) if not re.fullmatch(r"w\d", w) and i > 0])
            broken[at] = "otherwise"
            mandatory = "<<" not in template
            assert not (mandatory and accepts(template, " ".join(broken)))


def test_longest_acceptance_and_what_follows():
    t = {"x": "a <<beginOptional>>b<<endOptional>>"}
    assert scan("a b a a b", templates=t)[1] == [("x", False, 0, 2), ("x", False, 2, 3), ("x", False, 3, 5)]
    assert scan("a a a", phrases={"a a": "y"})[1] == [("y", True, 0, 2), ("y", True, 1, 3)]
    assert L._covered(scan("a a a", phrases={"a a": "y"})[1]) == 3


def test_scan_as_restated(spark):
    """Base columns by a plain restatement; odd texts, repeated ids, clashing names."""
    long = "mit license " + "x " * 50_000 + "released under the MIT\tLicense"
    texts = [None, "", "  -- ", "MIT license", "mit licenses", "permit license", "éMIT license", "cc-by CC BY cc.by", long, "GNU General Public Licensegnu general public license", "mit " * 500]
    texts += ["Licensed under the Apache License, Version 2.0.", "licensed under the apache license version 2", "Licensed under CC BY-NC 4.0.", "cc by nc 5 0"]
    rows = [(i % 13, t, 7, "o", 1) for i, t in enumerate(texts)] + [(None, "mit license", 7, "o", 1)]
    found = L.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()
    assert found[0].asDict().keys() == {"doc_id", "_others", "a b", *L._COLUMNS}
    assert len(found) == len(rows)
    plain = []
    for i, text, *_ in rows:
        ws = words(text)
        places = [(n, label) for p, label in L.PHRASES.items() for n in range(len(ws)) if ws[n : n + len(p.split())] == p.split()]
        starts = [n for n, _ in places]
        plain.append((i, len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found), key=key) == sorted(plain, key=key)
    by_words = {(r["n_words"], r["base_labels"]): r for r in found}
    assert by_words[8, "apache"]["labels"] == "apache,apache-2.0" and by_words[8, "apache"]["score"] == 1.0
    assert by_words[7, "apache"]["labels"] == "apache"
    assert by_words[7, "cc-by"]["labels"] == "cc-by,cc-by-nc-4.0" and by_words[7, "cc-by"]["score"] == 5 / 7
    assert all(0 <= r["score"] <= 1 for r in found)
    assert L.scan_licenses(spark.createDataFrame([], DOCS)).collect() == []
