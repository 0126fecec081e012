"""The ten operators against brute force, and on odd, clashing and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import cases
import numpy as np
import public_tokenizers
import pytest
from pyspark import Broadcast
from pyspark.sql import functions as F
from skein.llm import decontaminate, grid, language_id, license_scan, line_crf, near_dedup, packing, quality_rules, queries, repeats, substring_dedup, suffix_dedup, token_counts
from skein.llm.components import components
from skein.llm.runtime import Scratch
from skein.llm.tokens import Encoder
from tokenizers import Tokenizer

ODD = cases.odd_rows()
TEXTS = [(r[0], r[1]) for r in ODD]


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").orderBy("doc_id").collect()]


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def by_id(frame, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in frame.collect()}


# 1: quality rules


def test_quality_matches_its_oracle(spark, duck, sf):
    for name in ("op1_quality_rules", "op7_license_scan"):
        frame = queries.queries()[name](spark, sf)
        found = duck.execute(queries.oracle_sql()[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(frame.columns)
        assert Counter(tuple(r[c] for c in columns) for r in frame.collect()) == Counter(found.fetchall())


def test_quality_counts_on_odd_rows(spark):
    got = by_id(quality_rules.quality(cases.odd(spark)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for k, t in TEXTS:
        words = brute.SPACE_WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if brute.SPACE_WORD.search(x)]
        repeated = brute.repeat_words(t)
        failed = len(words) < 20 or 100 * repeated > 30 * len(words)
        assert got[k] == (len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated, failed), k


def test_quality_rejects_outliers_of_their_own_group(spark):
    clean = [(i, " ".join(f"w{(i * 7 + j) % 50}x" for j in range(30)), "en", "a", 1) for i in range(300)]
    noisy = [(1000 + i, " ".join(f"w{(i * 7 + j) % 50}%%%" for j in range(30)), "en", "b", 1) for i in range(300)]
    odd = [(2000, " ".join(f"w{j}%%%" for j in range(30)), "en", "a", 1), (2001, " ".join(f"w{j}%%%" for j in range(30)), "en", "b", 1)]
    got = by_id(quality_rules.quality(spark.createDataFrame(clean + noisy + odd, cases.DOCS)), "kept")
    assert got[2000] == (False,) and got[2001] == (True,) and all(got[k] == (True,) for k in (*range(300), *range(1000, 1300)))


@pytest.mark.parametrize("percent", [24, 26, 35, 45])
def test_quality_limits_hold_with_much_junk(spark, percent):
    def text(i, junk):
        words = [f"w{(i * 7 + j) % 50}" + "x" * ((i + j) % 5) for j in range(40)]
        noise = 30 + i % 40 if junk == "noisy" else i % 4
        short = [chr(97 + j % 26) + chr(97 + (i + j // 2) % 26) for j in range(40)]
        return " ".join(short if junk == "short" else words) + " " + "%" * noise

    rows = []
    for n, (source, junk) in enumerate((("a", "noisy"), ("b", "short"))):
        rows += [(1000 * n + i, text(i, junk if i < 4 * percent else ""), "en", source, 1) for i in range(400)]
    docs = spark.createDataFrame(rows, cases.DOCS)
    got = quality_rules.quality(docs).collect()
    assert not any(r.base_failed for r in got)
    assert [r.doc_id for r in got if r.kept != (r.doc_id % 1000 >= 4 * percent)] == []


def test_filter_keeps_rows_and_columns(spark):
    docs = cases.clashing(spark)
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and not set(kept.collect()) - set(docs.collect())


# 2: language


def test_language_held_out_accuracy(spark, sf):
    docs = documents(spark, sf)
    got = queries.queries()["op2_language_id"](spark, sf)
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert got.count() == docs.count() and sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got.collect())


def test_language_matches_brute_force(spark, sf):
    rows = documents(spark, sf).orderBy("doc_id").collect()
    labelled = [(r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    want = brute.languages(labelled, [r.text for r in rows])
    got = by_id(queries.queries()["op2_language_id"](spark, sf), "lang_pred")
    assert sum(got[r.doc_id][0] != w for r, w in zip(rows, want)) <= len(rows) // 100  # digits that some alphabets call letters


def test_language_odd_rows(spark):
    learned = language_id.learn(spark.createDataFrame([("the cat sat on the mat", "en"), ("der hund lief durch das haus", "de"), (None, "fr"), ("x", None)], "text string, lang string"))
    got = by_id(language_id.identify(cases.clashing(spark).filter("doc_id <> 5"), learned), "lang_pred", "score")
    for k, t in TEXTS:
        if k != 5:
            assert (got[k][0] == "und") == (not any(c.isalpha() for c in t or "")), (k, t)
    assert {r.lang_pred for r in language_id.identify(cases.odd(spark), []).collect()} == {"und"}


# 3: near duplicates


@pytest.mark.parametrize("options", [{}, {"block_docs": 4}])
def test_near_duplicates_match_all_pairs(spark, sf, options):
    docs = documents(spark, sf)
    got = near_dedup.near_duplicates(docs, **options)
    want = brute.near_components(pairs_of(docs))
    assert by_id(got, "n_shingles", "component_id") == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_near_chains_and_odd_rows(spark):
    rnd = random.Random(3)
    base = [f"t{rnd.randrange(10**6)}" for _ in range(200)]
    rows = list(TEXTS)
    for step in range(12):  # each is near the one before, not near the first
        base[step * 15 : step * 15 + 3] = [f"n{step}a", f"n{step}b", f"n{step}c"]
        rows.append((100 + step, " ".join(base)))
    docs = frame_of(spark, rows)
    for options in ({}, {"block_docs": 3}):
        assert by_id(near_dedup.near_duplicates(docs, **options), "n_shingles", "component_id") == brute.near_components(rows)


def test_near_pair_at_the_threshold_in_a_larger_group(spark):
    rnd = random.Random(18014)  # its first two texts share a band, are similar by 0.75 and agree in 58 % of their minima
    base = [f"t{rnd.randrange(10**6)}" for _ in range(74)]
    texts = [base, [{20: "n1", 50: "n2"}.get(i, w) for i, w in enumerate(base)]]
    texts += [[f"m{k}" if i == k else w for i, w in enumerate(base)] for k in (6, 11, 30, 35, 40, 60, 65, 68)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute.near_components(rows)
    assert want[1] == (70, 0)
    assert by_id(near_dedup.near_duplicates(frame_of(spark, rows)), "n_shingles", "component_id") == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}}


# 4 and 5: repeated windows


def test_repeated_words_match_brute_force(spark, sf):
    for rows in (pairs_of(documents(spark, sf)), TEXTS):
        got = by_id(substring_dedup.remove_repeats(frame_of(spark, rows)), "n_words", "n_removed", "kept_sha256")
        assert got == brute.repeated_words(rows, 35)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_earlier_bytes_match_brute_force(spark, sf, batches):
    rows = [(k, t if t is None else t[:20_000]) for k, t in pairs_of(documents(spark, sf))[:120]]
    got = by_id(suffix_dedup.remove_earlier(frame_of(spark, rows), batches=batches), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.earlier_bytes(rows, 100)


def pieced(seed, texts):
    rnd = random.Random(seed)
    parts = ["".join(rnd.choice("abcdefgh ") for _ in range(150)) for _ in range(6)]
    return [(i, "".join(rnd.choice(parts)[rnd.randrange(30) :] for _ in range(3)) + str(i)) for i in range(texts)]


def test_levels_merge_in_a_one_off_call(spark, monkeypatch):
    rows = pieced(8, 40)
    sizes, merges, merge = [], [], suffix_dedup.SuffixFamily._merge

    def seen(family):
        merge(family)
        sizes.append([n for n, _ in family.levels])
        merges.append(family.merges)

    monkeypatch.setattr(suffix_dedup.SuffixFamily, "_merge", seen)
    got = by_id(suffix_dedup.remove_earlier(frame_of(spark, rows)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.earlier_bytes(rows, 100)
    assert sizes == [[], [1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]] and merges == [0, 0, 1, 1, 3, 3, 4, 4]


def test_only_anchors_that_occur_again_are_compared(spark, monkeypatch):
    rnd = random.Random(11)
    rows = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(2_000))) for i in range(8)]
    rows = [*rows, *[(i, f"short {i}") for i in range(8, 12)]]  # the last batch has no window, so the newest array is never put in order
    rows[6] = (6, rows[6][1] + rows[1][1][300:700])
    counts, write = {}, Scratch.write

    def seen(scratch, frame, name="t", keep=False):
        out = write(scratch, frame, name, keep)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(Scratch, "write", seen)
    got = by_id(suffix_dedup.remove_earlier(frame_of(spark, rows), batches=3), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.earlier_bytes(rows, 100) and got[6][1] == 400
    assert counts["runs"] > 300 and 0 < counts["own"] < 40


def test_a_family_is_reopened_and_its_arrays_are_in_suffix_order(spark):
    rows = pieced(9, 30)
    docs = frame_of(spark, rows).select(F.col("doc_id").alias("key"), "text")
    family = suffix_dedup.SuffixFamily(Scratch(spark, "t"))
    for lo in (0, 7, 14):
        family.add(docs.filter(f"key >= {lo} AND key < {lo + 7}"))
    early = family.earlier(docs.filter("key < 21")).collect()
    later = suffix_dedup.SuffixFamily.reopen(spark, family.save())
    assert [n for n, _ in later.levels] == [2, 1] and later.last == 20
    with pytest.raises(ValueError, match="not above"):
        later.add(docs.filter("key = 20"))
    later.add(docs.filter("key >= 21"))
    windows = {r.ord + i for r in [*early, *later.earlier(docs).collect()] for i in range(r.n)}
    seen, want = set(), set()
    for k, t in rows:
        for i in range(len(t) - 99):
            want |= {(k << 27) + i} if t[i : i + 100] in seen else set()
            seen.add(t[i : i + 100])
    assert windows == want
    texts = dict(rows)
    for _, level in later.levels:
        heads = [texts[r.ord >> 27][(r.ord & (1 << 27) - 1) + r.lead :][:16] for r in sorted(level.collect(), key=lambda r: (r.a1, r.a2))]
        assert heads == sorted(heads) and len(heads) == level.distinct().count()


@pytest.mark.parametrize("step, segment", [(1, 40), (3, 1 << 20), (10, 40)])
def test_small_windows_over_a_small_alphabet(spark, step, segment, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    monkeypatch.setattr(repeats, "SLICE", 1 if segment == 40 else 1 << 20)  # each text by itself, in segments
    rnd = random.Random(step)
    rows = [(i, "".join(rnd.choice("ab ") for _ in range(rnd.randrange(120)))) for i in range(60)] + [(100, None), (101, "")]
    docs = frame_of(spark, rows)
    assert by_id(suffix_dedup.remove_earlier(docs, 12, 5, 3, step=step), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.earlier_bytes(rows, 12)
    assert by_id(substring_dedup.remove_repeats(docs, 6, 2), "n_words", "n_removed", "kept_sha256") == brute.repeated_words(rows, 6)


def test_paths_compact_and_their_spans_are_read(spark):
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(900)]
    other = [f"v{rnd.randrange(10**6)}" for _ in range(300)]
    rows = [(0, " ".join(base)), (1, " \n ".join(base)), (2, " ".join(other[:100] + base[200:500] + other[100:])), (3, " ".join(other))]
    docs = frame_of(spark, rows).select(F.col("doc_id").alias("key"), "text")
    scratch, tokens = Scratch(spark, "t"), repeats.Tokens(35, 10, grid.SPACE)
    again = substring_dedup.repeated(substring_dedup.vertices(docs, tokens), scratch)
    paths = substring_dedup.compacted(again, 10, scratch)
    totals = sorted(r.total for r in paths.select("path", "total").distinct().collect())
    assert len(totals) <= 8 and totals[-1] > 350  # the text before, inside and after the shared passage, and of the rest
    spans = substring_dedup.read(docs, substring_dedup.to_read(again, paths, 35, scratch), tokens)
    assert spans.filter("n > 1").groupBy("h", "w").count().filter("count < 2").isEmpty()
    assert by_id(substring_dedup.remove_repeats(frame_of(spark, rows)), "n_words", "n_removed", "kept_sha256") == brute.repeated_words(rows, 35)


def test_equal_rows_and_null_ids_are_separate_documents(spark):
    docs = cases.clashing(spark)
    long_rows = [r for r in suffix_dedup.remove_earlier(docs).collect() if r.doc_id == 5]
    assert len(long_rows) == 4 and sum(r.n_removed == 0 for r in long_rows) == 1  # the row without an id is the first copy
    words = [r for r in substring_dedup.remove_repeats(docs, 10, 5).collect() if r.doc_id == 5 and r.n_words == 20]
    assert len(words) == 3 and all(r.n_removed == 20 for r in words)


# 6: quality classifier


def test_crf_held_out(spark, sf):
    got = queries.queries()["op6_line_crf"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == documents(spark, sf).count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.collect())
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)


def test_crf_marginals_match_all_labelings():
    rnd = np.random.default_rng(0)
    chain = line_crf.Chain(3)
    chain.weights, chain.move = rnd.normal(size=3), rnd.normal(size=(2, 2))
    features, before = rnd.normal(size=(7, 3)), np.array([0, 3, 3, 7])
    got = chain.marginals(features, before)
    for a, b in ((0, 3), (3, 7)):
        total, good = 0.0, np.zeros(b - a)
        for code in range(2 ** (b - a)):
            y = [(code >> i) & 1 for i in range(b - a)]
            p = np.exp(sum(features[a + i] @ chain.weights * v for i, v in enumerate(y)) + sum(chain.move[u, v] for u, v in zip(y, y[1:])))
            total, good = total + p, good + p * np.array(y)
        assert np.allclose(got[a:b], good / total)


def test_crf_odd_rows(spark):
    chain = line_crf.learn(spark.createDataFrame([("good line of words here", 1), ("%%% $$$ ###", 0), (None, 1), ("x", None)], "text string, quality int"))
    got = line_crf.score(cases.clashing(spark), chain).collect()
    assert len(got) == cases.clashing(spark).count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in line_crf.score(cases.odd(spark).filter("doc_id < 3"), chain).collect()}) == 1


# 7: licences


def test_two_notices_in_one_text_and_broken_key_phrases(spark):
    mit, gpl = (next(t for name, _, t, _ in license_scan.TEMPLATES if name == n) for n in ("mit-grant", "gpl-notice"))
    filler = " ".join(f"w{i}" for i in range(300))
    rows = [(1, f"{filler} {mit}. {filler} {gpl}! {filler}"), (2, mit.replace("hereby granted", "hereby not granted")), (3, f"{mit} {mit}"), (4, "the software is free of charge and granted to copy"), (5, None)]
    got = by_id(license_scan.scan(frame_of(spark, rows)), "base_labels", "labels", "score")
    assert got == {1: ("gpl", "gpl,mit", 1.0), 2: ("", "", 0.0), 3: ("", "mit", 1.0), 4: ("", "", 0.0), 5: ("", "", 0.0)}


def test_licences_odd_rows(spark):
    got = by_id(license_scan.scan(cases.odd(spark)), "n_words", "n_base", "first_word", "base_labels", "labels", "score")
    assert got[12][1:5] == (1, 3, "mit", "mit") and got[12][5] == 1.0
    assert got[13][1] == 1 and got[13][3] == "cc-by" and got[13][4] == "cc-by,cc-by-nc"
    assert got[0] == (0, 0, None, "", "", 0.0) and license_scan.scan(cases.clashing(spark)).count() == cases.clashing(spark).count()
    for k, t in TEXTS:
        assert got[k][0] == len(brute.lower_words(t)), k


# 8: decontamination


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 2000}])
def test_contamination_matches_brute_force(spark, sf, options):
    docs, items = documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    short = [(900, "of the"), (901, "The, ED!"), (902, "the"), (903, None), (904, ""), (905, "of the"), (906, "one two three"), (907, "a a a a a a a a a a a a")]
    rows = [*pairs_of(docs), *[(10_000 + k, t) for k, t in TEXTS], (20_000, "a " * 40)]
    for own in (items, items.unionByName(spark.createDataFrame(short, items.schema))):
        got = by_id(decontaminate.contamination(frame_of(spark, rows), own, **options), "n_words", "n_hit", "n_items", "items_sha256")
        assert got == brute.contaminated(rows, [(r.item_id, r.text) for r in own.collect()])


def test_shards_come_one_after_the_other(spark, monkeypatch):
    made, alive = [], []
    broadcast, destroy = type(spark.sparkContext).broadcast, Broadcast.destroy

    def seen(context, value):
        made.append(len(value.items))
        alive.append(1 + (alive[-1] if alive else 0))
        return broadcast(context, value)

    def gone(self, blocking=False):
        alive.append(alive[-1] - 1)
        destroy(self, blocking)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", seen)
    monkeypatch.setattr(Broadcast, "destroy", gone)
    rnd = random.Random(6)
    words = [f"k{rnd.randrange(500)}" for _ in range(3000)]
    items = [("long", " ".join(words)), ("short", "k1 k2"), ("short", "k1 k2"), (None, " ".join(words[50:61])), ("", "k3 k4 k5"), ("none", None)]
    rows = [(1, " ".join(words[100:400])), (2, "x " + " ".join(words[990:1040]) + " y"), (3, " ".join(words[50:61])), (4, None), (5, "K1, k2! k3 k4 k5"), (6, " ".join(words[2980:]))]
    got = by_id(decontaminate.contamination(frame_of(spark, rows), spark.createDataFrame(items, "item_id string, text string"), shard_bytes=2000), "n_words", "n_hit", "n_items", "items_sha256")
    want = brute.contaminated(rows, [(n if n is not None else "null id", t) for n, t in items])
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    assert got[1] == want[1] and got[3][3] == hashlib.sha256(b"long").hexdigest()
    assert len(made) > 4 and max(alive) == 1 and alive[-1] == 0


def test_cleaned_texts_have_no_hits(spark, sf):
    docs, items = documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert decontaminate.contamination(clean, items).agg(F.sum("n_hit")).first()[0] == 0


# 9: token counts


def test_trees_follow_random_edits():
    known, rnd = Encoder(), random.Random(5)
    count = lambda texts: [len(x) // 4 for x in known.encode(texts)]
    full = lambda t: len(known.tokenizer.encode(t, add_special_tokens=False).ids)
    texts = [t or "" for _, t in TEXTS if not t or len(t) < 5000] + ["don't <|endoftext|> stop", " ́x Å 3 4,5..,"]
    for t in texts:
        for leaf in (5, 50, 400):
            ends = token_counts.leaf_ends(t, leaf)
            tree = token_counts.tree_of(count([t[a:b] for a, b in zip([0, *ends], ends)]))
            assert tree[1] == full(t)
            points = sorted(rnd.randint(0, len(t)) for _ in range(6))
            edits = [(a, b if rnd.random() < 0.5 else a, rnd.choice(["", " ", "xy", " new words ", "don't", "hello world " * 200])) for a, b in zip(points[::2], points[1::2])]
            text, _, after, _ = token_counts.recount(t, ends, tree, edits, count, leaf)
            assert text == token_counts.edited(t, edits) and after[1] == full(text)


def revised(t):
    """The query's edits, by hand."""
    n = len(t)
    if n < 60:
        return "Revised text. " + t
    a, b, c = int(n * (1 / 3)), int(n * (1 / 2)), int(n * (3 / 4))
    return t[:a] + "Revised text. " + t[a:b] + t[b + 10 : c] + "newer" + t[c + 5 :]


def test_token_counts_on_clashing_and_repeated_rows(spark):
    docs = cases.clashing(spark)
    trees = token_counts.build_trees(docs).withColumn("edits", token_counts.revision(F.col("text")))
    rows = token_counts.apply_edits(trees).collect()
    assert len(rows) == docs.count() and len({(r.n_before, r.n_tokens) for r in rows if r.doc_id == 5}) == 2
    assert token_counts.apply_edits(trees.filter("false")).count() == 0


def test_token_counts_of_documents(spark, sf):
    docs = documents(spark, sf)
    trees = token_counts.build_trees(docs).withColumn("edits", token_counts.revision(F.col("text")))
    rows = token_counts.apply_edits(trees).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    full = lambda t: len(whole.encode(t or "", add_special_tokens=False).ids)
    texts = dict(pairs_of(docs))
    for r in rows:
        assert r.n_tokens == full(r.text) and r.n_before == full(texts[r.doc_id])
        assert r.n_encoded <= 6 and r.text == revised(texts[r.doc_id] or "")
    assert len(rows) == docs.count() and token_counts.build_trees(cases.empty(spark)).count() == 0


# 10: packing


def check_packing(rows, pieces):
    known = Encoder()
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p.doc_id].append(p)
        of_sequence[p.sequence_id].append(p)
    for k, t in rows:
        ids, at = np.array([*known.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for p in sorted(of_doc[k], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for s in of_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY
    return sum(p.length for p in pieces) / (packing.CAPACITY * len(of_sequence))


def test_packing_is_a_round_trip_with_little_padding(spark, sf):
    docs = documents(spark, sf)
    assert check_packing(pairs_of(docs), packing.pack(docs, worker_rows=50).collect()) > 0.97


def test_packing_odd_rows(spark):
    check_packing(TEXTS, packing.pack(cases.odd(spark)).collect())
    twice = packing.pack(cases.clashing(spark)).filter("doc_id = 5").groupBy("doc_id", "start").count().collect()
    assert twice[0]["count"] == 4


# all of them


def test_empty_tables(spark, sf):
    none = cases.empty(spark)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    frames = [
        quality_rules.quality(none), quality_rules.filter_documents(none), language_id.identify(none, language_id.learn(none)), near_dedup.near_duplicates(none), near_dedup.keep_first(none), substring_dedup.remove_repeats(none),
        suffix_dedup.remove_earlier(none), suffix_dedup.strip_earlier(none), line_crf.score(none, line_crf.learn(none.selectExpr("text", "1 AS quality"))), license_scan.scan(none), decontaminate.contamination(none, items), decontaminate.clean(none, items), packing.pack(none),
    ]
    assert all(f.count() == 0 for f in frames)
    bare = decontaminate.contamination(cases.odd(spark), items.limit(0))
    assert bare.agg(F.sum("n_hit")).first()[0] == 0 and bare.count() == len(ODD)


def test_clashing_columns_and_repeated_ids(spark, sf):
    docs, items = cases.clashing(spark), spark.read.parquet(f"{sf}/benchmark.parquet")
    n = docs.count()
    frames = [quality_rules.quality(docs), near_dedup.near_duplicates(docs), substring_dedup.remove_repeats(docs), suffix_dedup.remove_earlier(docs), decontaminate.contamination(docs, items), license_scan.scan(docs)]
    assert all(f.count() == n for f in frames)
    for kept in (near_dedup.keep_first(docs), suffix_dedup.strip_earlier(docs), decontaminate.clean(docs, items)):
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes and 0 < kept.count() <= n


def test_hashes_do_not_depend_on_the_step():
    raw = np.frombuffer(cases.LONG.encode(), np.uint8)
    starts, ends, _ = grid.word_spans(raw, np.array([0, len(raw)]), grid.SPACE)
    assert (grid.span_hashes(raw, starts, ends, 1000) == grid.span_hashes(raw, starts, ends)).all()
    values = np.random.default_rng(0).integers(0, 1 << 60, 500).astype(np.uint64)
    for w in (1, 2, 7, 64, 100):
        assert grid.sliding_min(values, w).tolist() == [min(values[i : i + w].tolist()) for i in range(len(values) - w + 1)]


def test_grid_words_follow_the_patterns():
    import pyarrow as pa

    texts = [t for _, t in TEXTS]
    raw, offsets = grid.buffer_of(pa.array(texts, pa.string()))
    for table, words, fold in ((grid.SPACE, lambda t: brute.SPACE_WORD.findall(t or ""), False), (grid.NON_ALNUM, brute.lower_words, True)):
        data = grid.LOWER[raw] if fold else raw
        starts, ends, before = grid.word_spans(data, offsets, table)
        got = [data.tobytes()[s:e].decode() for s, e in zip(starts, ends)]
        assert [got[a:b] for a, b in zip(before, before[1:])] == [words(t) for t in texts]
