"""The corpus operators against brute force, round trips and edge cases."""

import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T

from timbral.llm import bpe, chat, decontaminate, html, jaccard, licenses, quality, queries, repeats, toxicity, warc
from timbral.llm.common import small_batches
from timbral.llm.shared import components, likely_rows, without
from timbral.llm.shingles import shingle_set

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
EDGES = [None, "", " \n\t ", "one", "two words", "é\u2028x", "a" * 5000, "x y z " * 2000, "same text of a few words here", "same text of a few words here"]
#: Columns that an operator could use for itself.
CLASH = "doc_id long, text string, id long, entity long, n long, place long, token long, mark long, hash long, core long, low long, spans string, score double"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


def table(spark, texts):
    return spark.createDataFrame([(i, t, *[0] * 9, "s", 0.0) for i, t in enumerate(texts)], CLASH)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=0, n=60):
    """Texts with exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    passages = [" ".join(word() for _ in range(90)) for _ in range(3)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.2:
            out.append(rng.choice(out))
        elif out and kind < 0.5:
            w = (rng.choice(out) or "x").split(" ")
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
        else:
            w = [word() for _ in range(rng.randrange(1, 200))]
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w[at:at] = [rng.choice(passages)]
            out.append(" ".join(w) + rng.choice(["", " é ü", "\nThe common line of many texts."]))
    return out


# --- 1 ------------------------------------------------------------------------------------------


def brute_classes(texts, size, percent):
    sets = []
    for t in texts:
        w = WORDS(lower(t))
        sets.append(frozenset(zip(*(w[i:] for i in range(size)))) if len(w) >= size else frozenset([tuple(w)] if w else []))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (2, 50)])
def test_jaccard_equals_brute_force(spark, size, percent):
    texts = corpus(size) + EDGES
    got = {r.doc_id: r for r in jaccard.classes(table(spark, texts), jaccard.Settings(shingle=size, percent=percent)).collect()}
    n, label = brute_classes(texts, size, percent)
    assert [got[i].n_shingles for i in range(len(texts))] == n
    assert [got[i].component_id for i in range(len(texts))] == label


def test_jaccard_prefix_grows_with_the_candidates():
    s = jaccard.Settings(shingle=5, percent=80)
    assert jaccard.chosen_l(100, np.zeros(100), s) == 1
    by_load = [jaccard.chosen_l(100, np.full(100, x), s) for x in (0.001, 0.02, 1.0, 1000.0)]
    assert by_load == sorted(by_load) and 1 == by_load[0] < by_load[-1] <= s.longest_l(100)
    late = np.where(np.arange(100) < 21, 0.01, 1000.0)  # lists behind the plain prefix are large: it stays short
    assert jaccard.chosen_l(100, late, s) == 1


@pytest.mark.parametrize("settings", [{}, {"wide_class": 1, "bucket_bits": 12}, {"rounds": 4, "pairs_a_row": 0.0, "pair_cost": 1000.0, "rare_others": 5.0}])
def test_jaccard_of_a_group_of_near_copies(spark, settings):
    """A group whose members are edits of a text that is not there: links inside are few, candidates many."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, texts = [word() for _ in range(70)], []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [" ".join(base[:60] + [word() for _ in range(k)]) for k in range(0, 30, 3)]
    got = {r.doc_id: r.component_id for r in jaccard.classes(table(spark, texts), jaccard.Settings(shingle=4, percent=85, **settings)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts, 4, 85)[1]


def test_jaccard_reads_the_lists_of_candidates_once(spark):
    """What the pairs' ends are joined to is written, so that its rows are made once whatever the size of the tables."""
    s = jaccard.Settings(shingle=4, percent=85)
    rows = [(token, entity, 100, 2 + (entity > 3), place, entity) for entity in (1, 2, 3, 4) for place, token in enumerate((10, 11, 12 + entity % 2))]
    lists = spark.createDataFrame(rows, "token long, entity long, n int, l int, place int, group long")
    found = jaccard._across(lists, s)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_jaccard_empty_table(spark):
    assert jaccard.classes(table(spark, []).limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 41), (7, 7), (None, 3)], "a long, b long")
    assert {r.id: r.component for r in components(edges).collect()} == {**{i: 0 for i in range(21)}, 40: 40, 41: 40}


def test_without(spark):
    rows = table(spark, ["a"] * 50)
    ids = spark.createDataFrame([(i,) for i in range(0, 50, 3)], "doc_id long")
    assert {r.doc_id for r in without(rows, ids, "doc_id").collect()} == {i for i in range(50) if i % 3}
    assert likely_rows(rows, ids, "doc_id").columns == rows.columns


# --- 2 ------------------------------------------------------------------------------------------


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("settings", [repeats.Settings(length=80), repeats.Settings(length=101, split_from=1, batch_bytes=500, shards=3), repeats.Settings(length=64, shards=1)])
def test_repeats_equal_brute_force(spark, settings):
    texts = corpus(9, 40) + EDGES + ["ab" * 300, "b" + "ab" * 200, "z" * 500]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove(table(spark, texts), settings, digests=True).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, settings.length)


def test_passages_are_reported_however_short(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    shared, less = prose(50), prose(25)
    texts = [" ".join(prose(rng.randrange(40)) + shared + prose(rng.randrange(40))) for _ in range(20)]
    texts += [" ".join(prose(60) + less + prose(60)) for _ in range(10)] + [" ".join(prose(80)) for _ in range(10)] + EDGES
    got = {r.doc_id: r for r in repeats.remove(table(spark, texts), repeats.Settings(length=400), digests=True, passage_words=50).collect()}
    assert all(got[i].n_passages >= 1 and got[i].n_removed == 0 for i in range(20)) and not any(got[i].n_passages for i in range(20, 40 + len(EDGES)))
    plain = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for _, r in sorted(got.items())]
    assert plain == brute_repeats(texts, 400) and not len(repeats.passage_cores(" ".join(shared[1:]), 50))


def test_transform_merge_finds_equal_strings():
    rng = np.random.default_rng(0)
    strings = rng.integers(0, 3, (200, 4)).astype(np.uint64)
    a, b = (repeats.Transform([x[:, k].copy() for k in range(4)]) for x in (strings[:90], strings[90:]))
    whole, blocks = repeats.merge(a, b)
    ordered = strings[whole.order]
    assert sorted(map(tuple, ordered.tolist())) == list(map(tuple, ordered.tolist()))
    assert [len(set(map(tuple, ordered[blocks == k].tolist()))) for k in set(blocks.tolist())] == [1] * len(set(map(tuple, strings.tolist())))


def test_clean_keeps_characters_whole(spark):
    shared = "äöü" * 60
    rows = table(spark, ["é" + shared + " left one", "è" + shared + " left two", shared, None])
    got = {r.doc_id: r.text for r in repeats.clean(rows, repeats.Settings(length=101)).collect()}
    assert got == {0: "éone", 1: "ètwo", 3: None}
    assert repeats.clean(rows.limit(0), repeats.Settings(length=100)).count() == 0


# --- 3 ------------------------------------------------------------------------------------------


def test_quality_counts_and_verdicts(spark):
    prose = "The cat sat on the mat and looked at the birds outside. " * 1
    good = " ".join(f"Word{i} follows word{i + 1} in this sentence." for i in range(20))
    junk = "\n".join([prose] + ["#### **** $$$$ %%%% more ####"] * 12 + [good])
    texts = [good, junk, "Home | About | Contact | Login | Help\n" * 30, *EDGES]
    got = {r.doc_id: r for r in quality.score_documents(table(spark, texts), with_text=True).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words, lines = WORDS(t), [x for x in t.split("\n") if WORDS(x)]
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t))
        assert r.n_dup_lines == sum(x in lines[:k] for k, x in enumerate(lines)) and r.n_repeat_words == len(covered)
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.base_failed and r.kept)
    assert got[0].kept and got[0].cleaned_text == good and not got[2].kept
    kept = quality.filter_documents(table(spark, texts)).collect()
    assert [r.text for r in kept if r.doc_id == 0] == [good] and all(r.cleaned_text is None for r in got.values() if not r.kept)


# --- 4 ------------------------------------------------------------------------------------------

ITEM = "A farmer named Anna sells 12 apples to her neighbour Bob every day, then Anna buys 5 kg of flour. How many apples does Anna sell in 30 days?"


def test_decontamination(spark):
    other = ITEM.replace("Anna", "Maria").replace("Bob", "Karl").replace("12", "17").replace("5 kg", "9 lbs")
    mixed = ITEM.replace("named Anna", "named Maria").replace("Anna buys", "Karl buys").replace("does Anna", "does Otto")
    quote = "She said that a farmer named Anna sells many things and nothing else of this is in any test at all."
    torn = mixed.replace("Bob", "Emil").replace("12", "17").replace("5 kg", "9 lbs").replace("30", "31")
    rows = table(spark, [f"Before this. {ITEM} After.", f"Words come first. {other}", mixed, quote, *EDGES, torn])
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (5, "eight words are the window of this test")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find(rows, items).collect()}
    assert set(got) >= {(0, 1), (1, 1)} and all(k[0] not in (3, *range(4, 14)) for k in got)
    assert got[0, 1].n_changed_slots == 0 and got[1, 1].n_changed_slots >= 3
    # one name stands for three: only what is verbatim beside it counts, and where nothing is, there is no hit
    assert got[2, 1].share < 0.75 and got[2, 1].n_changed_slots == 0 and (14, 1) not in got
    left = {r.doc_id for r in decontaminate.clean(rows, items).collect()}
    assert left == {i for i in range(15)} - {k[0] for k in got}
    assert decontaminate.find(rows, items.limit(0)).count() == 0 and decontaminate.find(rows.limit(0), items).count() == 0


def test_decontamination_equals_brute_force(spark):
    """All pairs of windows of all texts and items, without bitmap and join."""
    rng, s = random.Random(3), decontaminate.Settings()
    names, verbs = ["Anna", "Bob", "Carl", "Dora"], "sells buys takes gives finds keeps brings holds".split()
    made = lambda: " ".join(f"then {rng.choice(names)} {rng.choice(verbs)} {rng.randrange(99)} kg of the {rng.choice(verbs)} goods" for _ in range(3))
    items = [made() for _ in range(6)]
    texts = EDGES[:6] + [made() for _ in range(10)] + [f"Some words first. {rng.choice(items)} And more." for _ in range(5)]
    texts += [items[0].replace("Anna", "Emil").replace("Bob", "Fritz"), items[1].lower(), items[2].replace("kg", "lbs")]
    want = set()
    for d, text in enumerate(texts):
        form, slots = decontaminate.canonical(text)
        at, hashes = decontaminate.windows(form, slots, s.window, s)
        for i, item in enumerate(items):
            found = {}
            for named in (True, False):
                f, v = decontaminate.canonical(item, names=named)
                for p, h in zip(*decontaminate.windows(f, v, s.window, s)):
                    for a in at[hashes == h]:
                        m = dict(at=int(a), place=int(p), width=s.window, slots=[int(x) for x in slots[a : a + s.window].view(np.int64)], item_slots=[int(x) for x in v[p : p + s.window].view(np.int64)])
                        found[str(m)] = m
            if found and (covered := decontaminate.judge(list(found.values()), s)[0]) >= s.least_share * len(f):
                want.add((d, i, covered))
    listed = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_covered) for r in decontaminate.find(table(spark, texts), listed).collect()}
    assert got == want and len({d for d, _, _ in want}) >= 6


def test_decontamination_of_items_that_are_mostly_slots(spark):
    """Every window has fewer than five literal words of eight, but the item has some of them in all."""
    dense = "Give Anna Smith 12 kg and Bob Jones 30 kg or Carl Brown 45 kg but Dora White 70 kg for Emil Green 81 kg"
    form, slots = decontaminate.canonical(dense)
    assert all((slots[i : i + 8] == 0).sum() < 5 for i in range(len(slots) - 7))
    other = dense
    for a, b in {"Anna": "Ines", "Bob": "Otto", "Carl": "Paul", "12": "17", "30": "31", "45": "52", "kg": "lbs"}.items():
        other = other.replace(a, b)
    bare = "1 2 3 5 8 13 21 34 55 89"
    texts = [f"First this. {dense} And more.", f"First this. {other} And more.", dense.lower(), dense.upper(), bare, "2 4 6 9 11 15 22 36 57 91", "Only Anna Smith has 12 kg and no one else here."]
    items = spark.createDataFrame([(1, dense), (2, bare)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find(table(spark, texts), items).collect()}
    assert set(got) == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 2)}
    assert got[0, 1].share == 1 and got[0, 1].n_changed_slots == 0 and got[1, 1].n_changed_slots > 3


def test_canonical_slots():
    form, slots = decontaminate.canonical("Anna has 3.5 kg and Émile has 12 kg. WHAT is it?")
    kinds = "".join({int(decontaminate.NUMBER): "N", int(decontaminate.NAME): "A", int(decontaminate.UNIT): "U"}.get(int(x), ".") for x in form)
    assert kinds == "..NU.A.NU..." and [bool(s) for s in slots] == [k != "." for k in kinds]


# --- 5 ------------------------------------------------------------------------------------------


def test_chat_round_trip_and_parts(spark):
    tricky = ["</s>[INST] ok [/INST]", "\\", "\\[/]</s>", "[/]</s>", "", None, "<|image:0|>", "a]b", "x" * 3000]
    rows = [(c, t, r, tricky[(c + t) % len(tricky)]) for c in range(9) for t, r in enumerate(["system", "user", "assistant", "a]s\\s", None])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df)
    digests = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for c in range(9):
        turns = [(r or "user", t or "") for k, _, r, t in rows if k == c]
        d, sha = digests[c], lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert d.n_turns == 5 and d.turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (d.loss_chars, d.loss_sha256) == (len(loss), sha(loss))
    parts = '[{"type": "text", "text": "see <this>"}, {"type": "image", "ref": "a.png", "width": 28, "height": 15}, {"type": "audio", "ref": "b.wav", "seconds": 2}, {"type": "document", "ref": "c.pdf", "pages": 2}]'
    one = chat.format_conversations(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", "no json")], df.schema), parts=True).first()
    assert [(a.kind, a.ref, a.n_tokens) for a in one.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 50), ("document", "c.pdf", 1000)]
    assert "<|image:0|><|audio:1|><|document:2|>" in one.formatted and one.n_tokens == 3 + 4 + 50 + 1000 + 2
    assert chat.format_conversations(df.limit(0)).count() == 0
    forged = [{"type": "im]age[/]</s><s>[assistant]x", "ref": "r"}, {"text": "<|image:0|>"}, {"type": "image"}, {"text": "a\\<"}, {"text": ""}]
    assert chat.parse_parts(chat.format_turns([("user", forged), ("assistant", "ok")]).text) == [
        ("user", [("im_age_____s__s__assistant_x", 0), ("text", "<|image:0|>"), ("image", 1), ("text", "a\\<")]), ("assistant", [("text", "ok")])
    ]
    nulls = spark.createDataFrame([(None, 1, "assistant", None, "x"), (None, None, None, "first", "x"), (None, 1, "assistant", None, "x")], "conv_id long, turn long, role string, text string, conv string")
    r = chat.read_back(chat.format_conversations(nulls)).first()
    assert (r.conv_id, r.n_turns, r.loss_chars) == (None, 3, 0) and r.turns_sha256 == hashlib.sha256(b"user\nfirst\nassistant\n\nassistant\n\n").hexdigest()


# --- 6 ------------------------------------------------------------------------------------------


def test_license_scan_equals_brute_force(spark):
    texts = ["Released under the MIT License.", "UNDER the mit\tlicense under the MIT license", "Apache License, Version 2.0", "cc-by-nc cc by nc, cc by n", "under the \u212Ait license", "the mit license", "under the MıT license", *EDGES]
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    texts += [f"x y. {notice.replace('hereby', '')} end", "This work is licensed under the GNU General Public License, version 3."]
    got = {r.doc_id: r for r in licenses.scan(table(spark, texts)).collect()}
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    for i, t in enumerate(texts):
        w = split(lower(t))
        places = [(k, label) for label, p in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r, at = got[i], [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[len(texts) - 2].labels == "mit" and got[len(texts) - 1].labels == "gpl-3"
    both = "under the mit license x y z licensed under the gnu general public license version 3"
    alone = licenses.scan(spark.createDataFrame([(None, both), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.n_words, r.n_base, r.base_labels, r.labels) for r in alone) == [(0, 0, "", ""), (16, 1, "mit", "gpl-3,mit")]
    doubled = table(spark, texts[:2]).union(table(spark, texts[:2]))
    assert sorted(r.n_base for r in licenses.scan(doubled).collect()) == [1, 1, 2, 2]
    assert licenses.scan(doubled.limit(0)).count() == 0


# --- 7 ------------------------------------------------------------------------------------------


def test_html_keeps_all_words_of_broken_tables():
    """Words are single letters, as those behind an end tag without a start can touch."""
    words = lambda page: sorted(re.sub("<[^>]*>", " ", page).split())
    for inner in (
        "<tr><form><td>a<td>b</form><tr><td>c", "<tr><table><tr><td>a</table><td>b", "<tr>a<td>b", "<tbody>a<tr><td>b", "<tbody><td>a<td>b<tr><td>c", "<td>a<td>b", "a<tr>b<td>c</td>d</tr>e",
        "<tr><div>a<td>b</div>c<tr><td>d", "<thead><th>a<tbody><td>b<tfoot><td>c", "<colgroup><col><tr><td>a", "<colgroup>a<tr><td>b", "<caption>a<tr><td>b", "<p>a<p>b<tr><td>c",
        "<tr><td>a<table><td>b<tr>c</table>d<td>e", "<tr><p>a</p><td>b", "<tr><b>a</b><th>b", "<tbody><div>a<tr>b", "<tr><td>a</tr>b<tr><td>c", "<ul><li>a</ul><tr><li>b<td>c", "<tr><textarea>a</textarea><td>b",
    ):
        for page in (f"x<table>{inner}</table>y", f"x<table>{inner}", f"x<div><p>z <table>{inner}</table>y</div>", "<div>" * 185 + f"x<table>{inner}</table>y", f"x<tr>{inner}"):
            assert sorted(re.sub("[^a-z]", "", html.render(page))) == words(page), page[-200:]
        for depth in range(190, 202):  # flattened there
            page = "<div>" * depth + f"<table>{inner}</table>y"
            assert sorted(re.sub("[^a-z]", "", html.render(page))) == words(page), (depth, inner)
    assert html.render("<table><tbody><td>a<td>b<tr>x<td>c</table>") == "x\n\na  b\nc"


def test_html_rendering(spark):
    page = "<head><title>no</title></head><body>a<table><tr><td>x<td>long cell<tr><td>yyyy<td>z</table><ul><li>one<li>two<ol><li>i<li>j</ol></ul>b<br>c<pre> k\n  l</pre><p hidden>no<p style='display: none'>no<p>yes &amp; ok<script>no()</script><!-- no -->"
    assert html.render(page) == "a\n\nx     long cell\nyyyy  z\n\n- one\n- two\n\n  1. i\n  2. j\n\nb\nc\n\n k\n  l\n\nyes & ok"
    assert html.render("<p>one<p>two<div>three") == "one\n\ntwo\n\nthree"
    assert html.render("a < b and <3 <") == "a < b and <3 <"
    assert html.render("<div>" * 250 + "<p hidden>secret</p>visible") == "visible"
    assert html.render("<table><td>a<td>b<tr><td colspan=2>c</table>") == "a  b\nc"
    assert html.render("<table><tr><td rowspan=2>long<td>b<tr><td>c<tr><td colspan=2>wide cell<td>d</table>") == "long  b\n      c\nwide cell  d"
    assert html.render("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>") == "s\nt\nyes"
    assert html.render("<p style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</p>") == "yes"
    assert html.render("<ul><li>" * 300 + "x").endswith("- x") and html.render("<table><td>" * 2000 + "x") == "x"
    for broken in (None, "", "<", "<div", "<div>" * 5000 + "x", "</p></td>", "<table><tr>", "<!--", "<script>", "<a href='x>y"):
        html.render(broken)
    assert html.render("<div>" * 5000 + "x") == "x"
    got = html.extract(spark.createDataFrame([(1, None), (2, "<p>hi"), (2, "<p>hi")], "page_id long, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, ""), (2, "hi"), (2, "hi")]


# --- 8 ------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(1)
    common = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    bad = ["wretchbag", "scumlord", "nastygit", "foulmouth"]

    def text(toxic):
        w = rng.choices(common, k=120)
        for _ in range(4 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad)
        return " ".join(w)

    rows = [(text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    model = toxicity.train(rows[:300])
    got = {r.doc_id: r for r in toxicity.score_documents(table(spark, [t for t, _ in rows[300:]] + EDGES), model).collect()}
    assert np.mean([got[i].predicted == label for i, (_, label) in enumerate(rows[300:])]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert toxicity.train([]).score(0, 0) == pytest.approx(0.5) and 0 < toxicity.train([("a", 0)]).score(0, 1) < 0.5


def test_toxicity_sample_ignores_bad_labels(spark):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (2, 7), (None, 1), (3, 0)], "doc_id long, toxic int")
    assert sorted(toxicity.sample_rows(table(spark, ["a", "b", "c", "d"]), labels)) == [("a", 1), ("d", 0)]


# --- 9 ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load(RANKS, PATTERN).transducer.ranks, special_tokens={})


def test_bpe_equals_the_library(spark, encoding):
    own, rng = bpe.load(RANKS, PATTERN), random.Random(2)
    texts = ["".join(rng.choice("ab eé中\U0001f600 \n'sthion 19.,#" + chr(rng.randrange(32, 0x3000))) for _ in range(rng.randrange(60))) for _ in range(400)]
    for t in texts + [x for x in EDGES if x] + ["ab" * 4000, "th" * 3000 + "é"]:
        ids = own.encode(t)
        assert ids == encoding.encode_ordinary(t) and "".join(own.decode_stream(ids)) == t
    rows = table(spark, texts[:50] + EDGES)
    back = bpe.decode_documents(bpe.encode_documents(rows, RANKS, PATTERN), RANKS, PATTERN)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts[:50] + EDGES)}
    got = {r.doc_id: r for r in bpe.round_trip_digests(rows, RANKS, PATTERN).collect()}
    for i, t in enumerate(texts[:50] + EDGES):
        ids = encoding.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_pairs_that_stay_apart_are_those_that_plain_merging_keeps():
    own, rng = bpe.load(RANKS, PATTERN).transducer, random.Random(3)
    low = list(own.bytes_of)[:9000]
    short = [rank for rank, token in own.bytes_of.items() if len(token) <= 3]
    for _ in range(20_000):
        a, b = rng.choice(short), rng.choice(short if rng.random() < 0.5 else low)
        assert own.apart(a, b) == (own.merge(own.bytes_of[a] + own.bytes_of[b]) == (a, b))
    assert all(own.follows(-1, rank) == (own.merge(own.bytes_of[rank]) == (rank,)) for rank in short)


def test_utf8_stream_replaces_as_python_does():
    rng = random.Random(3)
    for _ in range(2000):
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0xF0, 0x90, 0xF4, 0xFF, 0x8F]) for _ in range(rng.randrange(8)))
        stream, out, at = bpe.Utf8Stream(), "", 0
        while at < len(data):
            n = rng.randrange(1, 4)
            out += stream.feed(data[at : at + n])
            at += n
        assert out + stream.close() == data.decode("utf-8", "replace")


# --- 10 -----------------------------------------------------------------------------------------


def test_revisits_equal_a_loop(spark):
    rng = random.Random(6)
    records = []
    for i in range(300):
        url = rng.choice(["http://www.A.com/x", "https://a.com/x/", "http://b.org/y?b=2&a=1&utm_source=z", "b.org:80/y?a=1&b=2#f", None])
        kind = rng.choice(["response", "revisit"])
        headers = {"ETag": f'"{rng.randrange(2)}"'} if rng.random() < 0.6 else {"Last-Modified": str(rng.randrange(2)), "content-type": kind} if rng.random() < 0.7 else None
        records.append((i, url, rng.randrange(500) if rng.random() < 0.95 else None, kind, headers, rng.choice([None, "d0", "d1"])))
    df = spark.createDataFrame(records, "record_id long, url string, time long, kind string, headers map<string,string>, digest string")
    got = {r.record_id: r for r in warc.resolve(df, slice_width=16).collect()}
    key = {None: None, "http://www.A.com/x": "a.com/x", "https://a.com/x/": "a.com/x", "http://b.org/y?b=2&a=1&utm_source=z": "b.org/y?a=1&b=2", "b.org:80/y?a=1&b=2#f": "b.org/y?a=1&b=2"}
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    for i, url, time, kind, headers, digest in records:
        if kind == "response":
            assert i not in got
            continue
        before = [r for r in records if r[3] == "response" and url and time is not None and r[2] is not None and key[r[1]] == key[url] and (r[2], r[0]) < (time, i)]
        source = max(before, key=lambda r: (r[2], r[0]), default=None)
        expect = "missing" if source is None else "unproven"
        if source:
            a, b = low(headers), low(source[4])
            for x, y in [(a.get("etag"), b.get("etag")), (a.get("last-modified"), b.get("last-modified")), (digest, source[5])]:
                if x is not None and y is not None:
                    expect = "resolved" if x == y else "mismatch"
                    break
        assert (got[i].outcome, got[i].source_id) == (expect, source and source[0])
        if expect == "resolved":
            assert got[i].headers == {**b, **{k: v for k, v in a.items() if k not in warc.NOT_MERGED}}
    assert warc.resolve(df.limit(0)).count() == 0


# --- all ----------------------------------------------------------------------------------------


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert jaccard.classes(df).count() == 4 and repeats.remove(df, digests=True).count() == 4 and licenses.scan(df).count() == 4
    assert quality.score_documents(df).count() == 4 and bpe.round_trip_digests(df, RANKS, PATTERN).count() == 4
    assert toxicity.score_documents(df, toxicity.train([])).count() == 4


def test_one_row_of_each_class_stays(spark):
    """Repeated rows, rows without an id and one id with two texts."""
    rng = random.Random(5)
    a, b, c, d = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(4))
    near = b + " more"
    listed = [(1, a), (1, a), (2, a), (3, b), (3, c), (4, near), (5, c), (None, d), (None, d), (None, near), (6, ""), (6, "")]
    rows = spark.createDataFrame([(i, t, len(t)) for i, t in listed], "doc_id long, text string, n_chars long")
    left = jaccard.one_of_each(rows, jaccard.Settings(shingle=5, percent=80))
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, [(1, a), (3, b), (3, c), (None, d), (6, ""), (6, "")]))
    cleaned = repeats.clean(left, repeats.Settings(length=200))
    assert sorted(r.text for r in cleaned.collect()) == sorted([a, b, c, d, "", ""])


def test_one_id_with_two_texts(spark):
    rng = random.Random(6)
    a, b, c = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(3))
    two = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, None), (4, c), (5, c + " z")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(two, jaccard.Settings(shingle=5, percent=80)).collect())
    assert got == [(1, 56, 1), (1, 56, 1), (2, 57, 1), (3, 57, 1), (4, 0, 4), (4, 56, 4), (5, 57, 4)]
    versions = spark.createDataFrame([(1, "head " + a), (1, b), (2, "other " + a), (3, None), (3, c), (4, c)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, bytes(r.kept)) for r in repeats.remove(versions, repeats.Settings(length=100)).collect())
    assert got == sorted([(1, len(a) + 5, b"head"), (1, len(b), b.encode()), (2, len(a) + 6, b"other"), (3, 0, b""), (3, len(c), b""), (4, len(c), b"")])


@needs_tables
def test_registered_queries_run_and_match_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(sql).df()
        columns = sorted(got.columns)
        shown = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
        assert columns == sorted(want.columns) and shown(got) == shown(want), name


@needs_tables
def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = pipeline.quality_rules(spark, docs, SF)
    texts = {r.doc_id: r.text for r in docs.collect()}
    verdicts = {i: quality.judge(t) for i, t in texts.items()}
    assert {r.doc_id: r.text for r in first.collect()} == {i: v.text for i, v in verdicts.items() if v.kept}
    second = pipeline.near_duplicates(spark, first, SF)
    ids = sorted(i for i, v in verdicts.items() if v.kept)
    _, label = brute_classes([verdicts[i].text for i in ids], 5, 80)
    assert {r.doc_id for r in second.collect()} == {i for k, i in enumerate(ids) if label[k] == k}
    out = pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} <= {r.doc_id for r in second.collect()} and all(r.round_trip and len(r.ids) == r.n_tokens for r in out)


def test_helpers(spark):
    small_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 400
    assert len(shingle_set("a b c d e", 4)) == 2 and len(shingle_set("a b", 4)) == 1 and not len(shingle_set(None, 4))
    assert isinstance(spark.createDataFrame([(1,)], "a long").schema, T.StructType)
