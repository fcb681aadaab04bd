"""Fill-in-the-middle, vector codes and I-Match fingerprints against brute force and on edge rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from timbral.llm import codes, imatch, infill

CLASH = ", id long, key string, h long, deal long, n long, code string, error long, form string, output string, __row long"
UNIT_PATTERNS = {"char": r"(?s).", "line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"}
TEXTS = ["", "a", "\n", "\n\n\nx\n\n", "one two  three\nfour ", " lead", "é\U0001f600\n z", "<P>held", "x" * 9 + "\n" * 5000 + "y"]


def clashing(spark, rows, schema):
    return spark.createDataFrame([(*r, 1, "k", 1, 1, 1, "c", 1, "f", "o", 1) for r in rows], schema + CLASH)


@pytest.mark.parametrize("unit", sorted(UNIT_PATTERNS))
def test_runs_give_the_offsets_of_units(unit):
    rng = random.Random(1)
    for text in TEXTS + ["".join(rng.choice("ab \n\té") for _ in range(rng.randrange(40))) for _ in range(300)]:
        index, units = infill.runs(text, unit), re.findall(UNIT_PATTERNS[unit], text)
        assert index.units == len(units)
        assert [index.offset(i) for i in range(len(units) + 1)] == [len("".join(units[:i])) for i in range(len(units) + 1)]
    assert len(infill.runs("\n" * 1_000_000, "line").start) == 2


def test_infill_outputs_and_round_trip(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, *(f"l{i}\nm\n{'n' * i}" for i in range(80))])] + [(None, "null\nid"), (5, TEXTS[5])]
    for s in (infill.Settings(), infill.Settings("word", 60, 20, "s"), infill.Settings("char", prefix="<|pre|>", suffix="<|suf|>", middle="<|mid|>")):
        made = infill.transform(clashing(spark, rows, "doc_id long, text string"), s)
        got = made.select("doc_id", "n", "form", "output", "prefix_chars", "middle_chars", infill.restored(s).alias("back")).collect()
        want = []
        for i, t in rows:
            t, units = t or "", re.findall(UNIT_PATTERNS[s.unit], t or "")
            h = hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()
            h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
            a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
            p, m, x = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
            if not t or any(mark in t for mark in s.marks) or h[2] % 100 >= s.percent:
                want.append((i, len(units), "plain", t, None, None, t))
            elif h[3] % 100 < s.spm_percent:
                want.append((i, len(units), "spm", s.suffix + x + s.prefix + p + s.middle + m, len(p), len(m), t))
            else:
                want.append((i, len(units), "psm", s.prefix + p + s.suffix + x + s.middle + m, len(p), len(m), t))
        assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_infill_refuses_marks_that_overlap_and_takes_empty_tables(spark):
    for bad in ("", "aba", "<P>"):  # "<P>" is the other mark, too
        with pytest.raises(ValueError):
            infill.Settings(suffix=bad)
    assert infill.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trees_find_the_nearest_entry_with_ties():
    rng = np.random.default_rng(2)
    for k in range(300):
        width, n, spread = rng.integers(1, 9), rng.integers(1, 40), rng.choice([1, 3, 50, codes.LARGEST])
        book, q = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread, spread + 1, (50, width))
        d = ((q[:, None, :] - book[None]) ** 2).sum(2)
        index, best = codes.nearest(codes.vantage_tree(book), book, q)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def test_roots_are_exact_near_squares():
    x = np.array([0, 1, 2, 3, 4, *(k * k + j for k in (3037000498, 94906267, 1 << 30) for j in (-1, 0, 1))])
    f, c = codes.floor_root(x), codes.ceil_root(x)
    assert all(int(a) ** 2 <= v < (int(a) + 1) ** 2 for a, v in zip(f, x.tolist())) and all((int(b) - 1) ** 2 < v <= int(b) ** 2 or v == b == 0 for b, v in zip(c, x.tolist()))


def brute_codes(rows, parts, entries, rounds, scale):
    kept = [(i, v, lab) for i, v, lab in rows if v and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    ints = [[int(np.floor(x * scale)) for x in v] for _, v, _ in kept]
    w = len(ints[0]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in ints]
    books = [[cut[e][p] for e in range(min(entries, len(cut)))] for p in range(parts)]
    near = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = [near(c[p], books[p])[1] for c in cut]
            books[p] = [[sum(col) // len(col) for col in zip(*(c[p] for c, a in zip(cut, at) if a == e))] if e in at else book for e, book in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    flat = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, sum(x for x, (_, _, o) in zip(error, kept) if o == lab), hashlib.sha256(flat.encode()).hexdigest()) for (i, _, lab), f, err in zip(kept, found, error)), key=str)


def test_codes_equal_brute_force_with_edge_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).round(2)], int(rng.integers(3))) for i in rng.permutation(70)]
    rows += [(5, rows[5][1], None), (None, [0.5] * 8, None), (200, None, 1), (201, [None] + [1.0] * 7, 1), (202, [float("nan")] * 8, 2), (203, [float("inf")] * 8, 2), (204, [1.0] * 7, 0), (205, [1.0] * 12, 0), (206, [], 0), rows[0], (207, [1.0] * 8, 1), (208, [1.0] * 8, 1)]
    df = clashing(spark, rows, "vec_id long, embedding array<double>, label int").repartition(5)
    s = codes.Settings(parts=4, entries=6, rounds=3, scale=100)
    want = brute_codes(rows, 4, 6, 3, 100)
    assert sorted((tuple(r) for r in codes.compressed(df, s).collect()), key=str) == want
    books = codes.train(df, s)
    coded = codes.encode(df, books, label_col="label")
    salted = codes.with_label_error(coded, few=0)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in salted.collect()), key=str) == sorted((w[:4] for w in want), key=str)
    back = {(r["vec_id"], r["code"]): r["v"] for r in coded.select("vec_id", "code", codes.decoded(books).alias("v")).collect()}
    for (_, code), v in back.items():
        assert [round(x * 100) for x in v] == [x for p in range(4) for x in books.books[p][int(code[2 * p : 2 * p + 2], 16)].tolist()]


def test_codes_of_empty_tables_and_of_fewer_vectors_than_entries(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert codes.compressed(spark.createDataFrame([], schema)).count() == 0
    assert codes.compressed(spark.createDataFrame([(1, None, 1), (2, [None] * 8, 1)], schema)).count() == 0
    rows = [(i, [float(i)] * 8, None) for i in range(3)]
    assert sorted((tuple(r) for r in codes.compressed(spark.createDataFrame(rows, schema)).collect()), key=str) == brute_codes(rows, 8, 16, 6, 4096)


def brute_prints(rows, s):
    words = lambda t: set(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    sets = [words(t) for _, t in rows]
    df = {w: sum(w in x for x in sets) for x in sets for w in x}
    band = {w for w, n in df.items() if n * s.common <= len(rows) <= n * s.rare}

    def member(term, k):
        if not k:
            return True
        scale, place = divmod(k - 1, s.subsets)
        digest = hashlib.sha256(f"{term} {scale} {place // 16}".encode()).hexdigest()
        return int(digest[place % 16 * 4 :][:4], 16) * s.scales[scale] < 65536

    def mark(t):
        terms = sorted(words(t) & band)
        parts = [[w for w in terms if member(w, k)] for k in range(s.size)]
        return "".join(hashlib.md5(" ".join(p).encode()).hexdigest()[:4] if p else "----" for p in parts)

    return mark


def alike(a, b):
    pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(0, len(a), 4)]
    met = [x == y for x, y in pairs if (x, y) != ("----", "----")]
    return sum(met) / len(met) if met else 1.0


@pytest.mark.parametrize("most_terms", [1 << 19, 3])
def test_fingerprints_against_edited_texts(spark, most_terms):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 4)))
    rows = [(i, " ".join(word().title() for _ in range(rng.randrange(1, 60)))) for i in rng.sample(range(100), 60)] + [(200, None), (201, ""), (202, " \n "), (203, "zz " * 3000), (7000, "the same"), (7001, "the same")]
    s = imatch.Settings(common=3, rare=30, scales=(2, 16), subsets=16, most_terms=most_terms)
    mark, ordered = brute_prints(rows, s), sorted(rows)
    want = []
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        t, n = t or "", n or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), mark(t), mark(e), round(alike(mark(t), mark(e)), 9), round(alike(mark(t), mark(n)), 9)))
    df = clashing(spark, rows, "doc_id long, text string").repartition(6)
    got = [(*r[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in imatch.against_edited(df, s).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()]
    assert sorted(got) == sorted(want)
    prints = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(df, settings=s).collect()}
    assert prints == {i: mark(t) for i, t in rows} and prints[7000] == prints[7001]
    assert imatch.alike(["----"] * 3, ["----"] * 3) == 1.0 and imatch.alike(["aaaa", "----", "bbbb"], ["aaaa", "----", "cccc"]) == 0.5


def test_fingerprints_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert imatch.against_edited(spark.createDataFrame([], schema)).count() == 0
    one = imatch.against_edited(spark.createDataFrame([(1, "abcdef")], schema)).collect()
    assert [r["edited_sha256"] for r in one] == [hashlib.sha256(b"abcabc").hexdigest()]
    same = [(3, "a b")] * 40 + [(None, "x y")] * 5 + [(None, None), (1, "q")]
    got = imatch.against_edited(spark.createDataFrame(same, schema).repartition(4)).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == sorted((str(i), len(t or "")) for i, t in same)
    assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == 3) >= 39
