"""Operators against brute force on small tables that hold the hard cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontamination, language, nearjoin, packing, quality, sentences, suffixes, topk, urls
from quarry.sources.tables import table

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


@pytest.fixture(scope="module")
def texts():
    """Texts with copies, near copies, shared passages, nulls, empties, one word, other alphabets, and a long one."""
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 7))) for _ in range(400)]

    def say(n):
        return " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))

    passages = [say(n) for n in (30, 60, 90)]
    out = [None, "", " ", "...", "word", "one two three", "Ünïcödé ßtraße 漢字 текст"]
    for _ in range(60):
        out.append(say(rnd.randint(5, 120)))
        if rnd.random() < 0.5:
            out[-1] += " " + rnd.choice(passages) + " " + say(rnd.randint(0, 30))
    for k in range(12):
        base = out[10 + k].split(" ")
        for _ in range(rnd.randint(1, 4)):
            base[rnd.randrange(len(base))] = rnd.choice(vocabulary)
        out.append(" ".join(base))
    out += [out[20], out[20], out[21].upper(), "ab " * 900, say(6000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", 0, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


# N-gram Jaccard join


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes_by_force(texts, similarity=0.8):
    sets = [shingles(t) for t in texts]
    label, n = list(range(len(sets))), [0] * len(sets)
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                n[i] += 1
                n[j] += 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return {i: (label[i], n[i]) for i in range(len(sets))}


@pytest.mark.parametrize(("small", "tile"), [(64, 1024), (1, 2), (2, 1024)])
def test_near_duplicates(docs, texts, small, tile):
    got = {r.doc_id: (r.class_id, r.n_links) for r in nearjoin.classes(docs, small=small, tile=tile).collect()}
    assert got == classes_by_force(texts)


def test_one_of_each_group(docs, texts, none):
    want = classes_by_force(texts)
    kept = nearjoin.distinct(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (c, _) in want.items() if c == i}
    assert nearjoin.classes(none).count() == 0


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f g")] * 3 + [(None, "a b c d e f g"), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in nearjoin.distinct(df).collect()) == [(1, "a b c d e f g"), (2, "")]


def test_one_of_several_texts_of_one_id_stays(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    rows = [(1, " ".join(base)), (1, " ".join([*base, "end"])), (2, " ".join(base)), (1, "something else that is of a class of its own"), (3, "...")] + [(4, "...")] * 2
    got = sorted((r.doc_id, r.text) for r in nearjoin.distinct(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [d for d, _ in got] == [1, 1, 3, 4, 4] and (1, rows[3][1]) in got


def test_runs_follow_the_recall():
    plans = [nearjoin.Plan(0.8, r) for r in (0.5, 0.9, 0.999, 0.99999, 0.9999999)]
    assert [p.runs for p in plans] == sorted(p.runs for p in plans) and plans[0].runs < plans[2].runs < plans[4].runs
    assert plans[1].agree[32] > plans[3].agree[32] > 8 and nearjoin.Plan(0.5, 0.999).runs > plans[2].runs


@pytest.mark.parametrize(("recall", "similarity"), [(0.9, 0.8), (0.999, 0.8), (0.99, 0.5)])
def test_recall_is_reached(spark, recall, similarity):
    """Pairs at just the similarity: one text, and one with words more, that share what is asked for and no more."""
    rnd = random.Random(int(recall * 1000))
    texts = []
    for i in range(700):
        base = [f"{rnd.randrange(10**6)}" for _ in range(64)]
        more = [f"{rnd.randrange(10**6)}" for _ in range(int(60 / similarity - 60))]
        texts += [" ".join(base), " ".join(base + more)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = nearjoin.classes(df, similarity, recall=recall).where("n_links > 0").count() / 2
    assert 700 * recall - 3 * (700 * recall * (1 - recall)) ** 0.5 <= found <= 700


def test_splits_of_any_depth_lose_nothing(spark):
    """Sets that share one another's tokens in a tree, so that buckets are split again and again."""
    rnd = random.Random(2)
    texts = []
    for i in range(60):
        head = [f"h{i % 2}"] * 5 + [f"m{i % 4}"] * 5 + [f"n{i % 8}"] * 6
        texts.append(" ".join(head + [f"{rnd.randrange(9)}" for _ in range(rnd.randrange(6))]))
    texts += [f"{t} z" for t in texts[::3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in nearjoin.classes(df, small=2, tile=3).collect()}
    assert got == classes_by_force(texts)


def rows_made(spark, run):
    """Rows out of all Generate nodes of what `run` executes."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for i in range(before, store.executionsCount()):
        execution = store.executionsList().apply(i).executionId()
        nodes, values = store.planGraph(execution).allNodes(), store.executionMetrics(execution)
        for metrics in (nodes.apply(j).metrics() for j in range(nodes.size()) if "Generate" in nodes.apply(j).name()):
            for m in (metrics.apply(k) for k in range(metrics.size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


def test_a_bucket_that_stays_whole_costs_a_fixed_number_of_rows(spark):
    """Each set shares eight tokens with all others, and its two least ones with none: only tokens further on tell that a split doesn't pay."""
    plan, made, n = nearjoin.Plan(0.8, 0.99999), [], (500, 2000)
    for m in n:
        kinds = spark.createDataFrame(
            [(b"%d" % i, 64, [1], [2 * i, 2 * i + 1, *range(10**6, 10**6 + 8)], 1) for i in range(m)], "sig binary, size int, opens array<long>, tokens array<long>, copies long"
        ).localCheckpoint()
        found = []
        made.append(rows_made(spark, lambda: found.append(nearjoin.paths(kinds, 64, plan))) - 2 * m)  # less those of the tokens chosen
        assert found[0].select("path", "ended", "m").distinct().collect() == [([1], False, m)] and found[0].count() == m
    assert 0 < max(made) < 2 * 64 * plan.follow


def test_a_large_bucket_is_judged_by_some_of_its_sets_and_split_whole(spark):
    """3,000 sets that share one chosen token, in groups of ten that share all sampled ones: every set is in the part of each of its tokens."""
    kinds = spark.createDataFrame([(b"%d" % i, 64, [1], [10 * (i // 10) + j for j in range(10)], 1) for i in range(3000)], "sig binary, size int, opens array<long>, tokens array<long>, copies long")
    got = nearjoin.paths(kinds, 64, nearjoin.Plan(0.8, 0.99999)).select("sig", "path", "m").collect()
    assert {(r.sig, r.path[1]) for r in got} == {(b"%d" % i, 10 * (i // 10) + j) for i in range(3000) for j in range(10)}
    assert {r.m for r in got} == {10} and {tuple(r.path[:1]) for r in got} == {(1,)} and len(got) == 30_000


# Suffix-array dedup


def removed_by_force(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [2, 5, 512])
def test_suffix_dedup(docs, texts, monkeypatch, most):
    real = suffixes.spans
    monkeypatch.setattr(suffixes, "spans", lambda d, length: real(d, length, most=most))
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.digest(docs).collect()}
    assert got == dict(enumerate(removed_by_force(texts, 400)))


def test_passages_of_both_lengths(spark, docs, texts, none):
    rnd = random.Random(6)
    shared = ["".join(rnd.choice("abcdé ") for _ in range(n)) for n in (239, 260, 300, 399, 420, 600, 900)]
    more = [f"own {i} {shared[i % 7]} between {i} {shared[(i + 1) % 7]} end {i}" for i in range(14)] + [shared[6] * 2, shared[5], shared[5], shared[2], shared[2]]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    ids, both = [*range(len(texts)), *range(1000, 1000 + len(more))], [*texts, *more]
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.passages(rows).collect()}
    narrow, wide = removed_by_force(both, 400), removed_by_force(both, 240)
    assert got == {i: (*n, w[1]) for i, n, w in zip(ids, narrow, wide, strict=True)}
    assert sum(w[1] > n[1] > 0 for n, w in zip(narrow, wide, strict=True)) > 3
    assert suffixes.passages(none).count() == 0


def test_suffix_edges(spark, none):
    rows = [(1, "x" * 399), (2, "x" * 399), (3, "y" * 400), (4, "z" + "y" * 400), (5, "w" * 401), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.digest(df).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (400, 1), 4: (400, 1), 5: (401, 1), 6: (0, 0)}
    assert suffixes.digest(none).count() == 0


def test_trim_keeps_columns_and_characters(docs, texts):
    cut = suffixes.trim(docs)
    assert cut.columns == docs.columns
    got = {r.doc_id: r.text for r in cut.collect()}
    for i, (n, gone, _, _) in enumerate(removed_by_force(texts, 400)):
        assert (got[i] is None) == (texts[i] is None)
        assert 0 <= len((got[i] or "").encode()) - (n - gone) <= 3 * max(1, gone // 400 + 1) * 2


# Decontamination


@pytest.mark.parametrize("block_words", [10, 4_000_000])
def test_decontamination(spark, docs, texts, block_words):
    items = [(1, " ".join(texts[12].split()[3:25])), (2, " ".join(texts[15].split()[:13])), (3, "word"), (10, None), (11, "..."), (12, texts[30].upper()), (12, texts[30]), (None, texts[13])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(item)
    want = {}
    for d, text in enumerate(texts):
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        want[d] = (len(w), len(hit), len([i for i in found if i is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    rows = decontamination.judged(docs, benchmark, block_words=block_words)
    got = {r.doc_id: (r.n_words, r.n_hit, len(r.items), hashlib.sha256(",".join(r.items).encode()).hexdigest(), r.contaminated) for r in rows.collect()}
    assert got == want and sum(v[4] for v in want.values()) >= 4
    clean = decontamination.clean(docs, benchmark)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {d for d, v in want.items() if not v[4]}


def longest_by_force(text, item):
    """Maximal verbatim matches of at least a window: (start, end, place)."""
    a, b = words(text), words(item)
    least, out = min(13, len(b)), set()
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] != b[j] or (i and j and a[i - 1] == b[j - 1]):
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= least:
                out.add((i, i + n, j))
    return out


@pytest.mark.parametrize("block_words", [10, 4_000_000])
def test_matches_are_of_full_length_and_have_their_places(spark, block_words):
    rnd = random.Random(4)
    items = [(k, " ".join(rnd.choice("a b c d e f g h i j".split()) + str(rnd.randrange(9)) for _ in range(40))) for k in range(6)] + [(6, "x y " * 15), (7, "same " * 20)]
    cut = [t.split() for _, t in items]
    docs = [" ".join(["own", *cut[0][2:20], "between", *cut[0][10:40], *cut[1][:13]]), " ".join([*cut[2], *cut[2][5:30]]), "x y " * 9, " ".join(cut[3][:12]), "same " * 33, " ".join([*cut[4][20:35], *cut[4][35:], "Z", *cut[5][:20], *cut[4][:13]])]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = decontamination.matches(df, spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()
    for r in rows:
        got = collections.defaultdict(set)
        for m in r.matches:
            got[m["item_id"]].add((m["start"], m["end"], m["place"]))
        for item, text in items:
            want = longest_by_force(r.text, text)
            assert got[item] <= want
            assert {x for s, e, _ in got[item] for x in range(s, e)} == {x for s, e, _ in want for x in range(s, e)}
            if item < 6:
                assert got[item] == want
    assert sum(len(r.matches) for r in rows) >= 8


def test_decontamination_of_nothing(spark, docs, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.digest(docs, empty).where("n_hit > 0").count() == 0
    assert decontamination.digest(none, empty).count() == 0


# Packing


def test_tree_finds_the_tightest():
    rnd, tree, have = random.Random(1), packing.CapacityTree(50), collections.Counter()
    for _ in range(2000):
        x = rnd.randint(1, 50)
        if rnd.random() < 0.5 or not have[x]:
            have[x] += 1
            tree.add(x, 1)
        else:
            have[x] -= 1
            tree.add(x, -1)
        least = rnd.randint(1, 50)
        assert tree.tightest(least) == min((c for c, n in have.items() if n and c >= least), default=None)


def best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return len(room)


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(2)
    for _ in range(30):
        lengths = [min(64, int(rnd.expovariate(0.05)) + 1) for _ in range(rnd.randint(0, 200))]
        table, made = packing.plan(collections.Counter(lengths), 64)
        assert made == best_fit(lengths, 64)
        del table


@pytest.mark.parametrize("library", ["tiktoken", "tokenizers"])
def test_packing(docs, texts, library):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, library=library).collect()
    by_doc, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    lengths = []
    for d, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[d], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert r.length == 1024 or k == 0
            at += r.length
            lengths.append(r.length)
        assert at == len(ids)
    for spans in sequences.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= 1024
    assert len(sequences) == best_fit(lengths, 1024)


def test_special_tokens_and_unicode_match_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing._tokenizer("byte_bpe_50k", "tiktoken")
    rnd = random.Random(5)
    alphabet = "ab 'sé漢\u0085​ \n\t1²½Ⅷ!¿\U0001f600́ﬁ<|>"
    samples = ["<|endoftext|> a", "x <|endoftext|>", "I'll we've", ""] + ["".join(rnd.choice(alphabet) for _ in range(40)) for _ in range(300)]
    for s in samples:
        assert fast(s).tolist() == full.encode(s, add_special_tokens=False).ids


def test_packing_nothing(none):
    assert packing.pack(none).count() == 0


# Sentence spans


def test_sentence_spans(spark, none):
    passage = "Alpha beta gamma delta epsilon zeta eta theta. Iota kappa lambda mu nu xi omicron pi rho sigma tau. Upsilon phi chi psi omega and more words to come."
    rows = [(1, f"Own start here. {passage} Own end."), (2, f"{passage}"), (3, f"Other words first!\n{passage}\nAnd last ones."), (4, "Short. Text."), (5, None), (6, ""), (7, "Own start here. Own end.")]
    got = {r.doc_id: r for r in sentences.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.n_removed for d, r in got.items()} == {1: 0, 2: 3, 3: 3, 4: 0, 5: 0, 6: 0, 7: 0}
    assert got[3].text == "Other words first!\nAnd last ones." and got[1].text == rows[0][1]
    assert got[3].n_words_removed == len(passage.split())
    assert sentences.dedup(none).count() == 0


@pytest.mark.parametrize("hot", [1, 300, 10**6])  # no hash, some, and all that repeat
def test_sentence_spans_against_brute_force(docs, texts, monkeypatch, hot):
    monkeypatch.setattr(sentences, "HOT", hot)

    def cut(text):
        return [w for w in (words(s) for s in re.split(r"(?<=[.!?])(?=\s|$)|\n", text or "")) if w]

    first, gone = {}, collections.defaultdict(set)
    for d, text in enumerate(texts):
        s = cut(text)
        for i in range(len(s)):
            j, n = i, len(s[i])
            if n < sentences.ALONE:
                while j < len(s) and (n < sentences.LEAST or j == i):
                    j += 1
                    n += len(s[j]) if j < len(s) else 0
            if j < len(s):
                key = tuple(w for x in s[i : j + 1] for w in x)
                if first.setdefault(key, (d, i)) != (d, i):
                    gone[d] |= set(range(i, j + 1))
    got = {r.doc_id: (r.n_sentences, r.n_removed) for r in sentences.dedup(docs).collect()}
    assert got == {d: (len(cut(t)), len(gone[d])) for d, t in enumerate(texts)}


def removed_of_all_runs(split, least, alone):
    """Of texts as lists of sentences (lists of words): the sentences that any run that repeats covers, but for its first occurrence."""
    places, gone = collections.defaultdict(list), collections.defaultdict(set)
    for d, s in enumerate(split):
        for i in range(len(s)):
            for j in range(i, len(s)):
                run = tuple(map(tuple, s[i : j + 1]))
                n = sum(map(len, run))
                if n >= (least if j > i else alone):
                    places[run].append((d, i, j))
    for found in places.values():
        for d, i, j in found[1:]:
            gone[d] |= set(range(i, j + 1))
    return gone


@pytest.mark.parametrize(("least", "alone", "hot"), [(20, 20, 1), (20, 40, 10**6), (12, 12, 300), (12, 30, 300)])
def test_sentence_spans_cover_all_that_repeats(spark, monkeypatch, least, alone, hot):
    monkeypatch.setattr(sentences, "HOT", hot)
    rnd = random.Random(5)
    say = lambda n: [rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randrange(999)) for _ in range(n)]
    stock = [say(rnd.choice([1, 3, 5, 12, 12, 25, 41])) for _ in range(40)]
    # Sentences of 12, 12 and 5 words first: nothing of 20 words follows the second.
    split = [[say(12), say(12), say(5)]]
    split += [[say(3), *split[0], say(4)], [say(6), split[0][1], split[0][2]]]
    for _ in range(60):
        at, n = rnd.randrange(len(stock)), rnd.randint(1, 9)
        split.append([say(rnd.randint(1, 30)), *stock[at : at + n], say(rnd.randint(1, 30)), *stock[: rnd.randint(0, 3)], *rnd.choice(split)[:2]])
    df = spark.createDataFrame([(d, ". ".join(" ".join(s) for s in text) + ".") for d, text in enumerate(split)], "doc_id long, text string")
    want = removed_of_all_runs(split, least, alone)
    got = {r.doc_id: r.n_removed for r in sentences.dedup(df, least, alone, whole=True).collect()}
    assert got == {d: len(want[d]) for d in range(len(split))}
    assert got[1] == 3


def test_one_sentence_of_twenty_words_is_found_between_parts(spark):
    shared = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(1, f"own part one. {shared}. and own"), (2, f"another part. {shared}. then more")], "doc_id long, text string")
    assert {r.doc_id: r.n_words_removed for r in sentences.digest(df).collect()} == {1: 0, 2: 20}


# Top-k


@pytest.mark.parametrize("big", [1, 2**40])
def test_topk(spark, big):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) * big for x in rng.normal(0, 0.3, 40)]) for i in range(230)]
    rows += [(300, rows[5][1]), (350, rows[5][1]), (400, None), (450, [float("nan")] * 40), (500, [None] * 40), (None, rows[1][1]), (550, [0.0] * 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    valid = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and None not in v and all(np.isfinite(v))]
    want = set()
    for q, x in valid:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in valid if i != q)[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(found)}
    if big > 1:
        want = {w for w in want if abs(w[3]) < 2**63}
    got = {tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, 5, query_block=3, candidate_block=16, group=4).collect()}
    assert got == want if big == 1 else {g[:3] for g in got if g[0] == 550} == {w[:3] for w in want if w[0] == 550}


def test_topk_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [0.5])], schema)
    assert [tuple(r) for r in topk.search(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 128)]


# URL filters


def test_rules(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?q", ""), (2, "http://a.example.net/de/", ""), (3, "https://example.com/de/a#f", ""), (4, "https://badexample.com/de/a", ""), (5, "ftp://x.org/fr/", ""),
        (6, None, None), (7, "no scheme", None), (8, "http://net", ""), (9, "http://b.net?x", ""), (10, "http://c.net/", ""), (11, "http://x.org/fr", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2] is None and got[5][2:] == ("org/fr/", "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8][:3] == ("net", "", None) and got[9][:3] == ("b.net", "", None) and got[10][2] == "net/" and got[11][2] is None
    assert urls.judge(df.limit(0)).count() == 0


def test_distrust_spreads_against_links_and_trust_along_them(spark):
    link = lambda *hosts: "".join(f'<a class="x" HREF="http://{h}/">l</a>' for h in hosts)
    rows = [
        (1, "http://bad.net/", ""), (2, "http://farm.com/", link("bad.net", "bad.net")), (3, "http://ring.com/", link("farm.com")), (4, "http://good.org/fr/", link("friend.com")),
        (5, "http://friend.com/", ""), (6, "http://alone.com/", link("alone.com")), (7, "http://friend.com/2", link("bad.net")),
    ]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {p: r.verdict for p, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    # The same by plain power iteration.
    edges = {("farm.com", "bad.net"): 2, ("ring.com", "farm.com"): 1, ("good.org", "friend.com"): 1, ("friend.com", "bad.net"): 1}

    def power(e, seeds):
        out, score = collections.Counter(), dict(seeds)
        for (a, _), n in e.items():
            out[a] += n
        for _ in range(8):
            new = collections.Counter({h: 0.15 * s for h, s in seeds.items()})
            for (a, b), n in e.items():
                new[b] += 0.85 * score.get(a, 0) * n / out[a]
            score = new
        return score

    trust, distrust = power(edges, {"good.org": 1.0}), power({(b, a): n for (a, b), n in edges.items()}, {"bad.net": 1.0})
    for r in got.values():
        assert r.trust == pytest.approx(trust.get(r.host, 0)) and r.distrust == pytest.approx(distrust.get(r.host, 0))


def test_distrust_reaches_hosts_many_links_away(spark):
    hosts = ["bad.net", *(f"h{k}.com" for k in range(1, 13))]
    rows = [(k, f"http://{h}/", f'<a href="http://{hosts[k - 1]}/">l</a>' if k else "") for k, h in enumerate(hosts)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(13):
        assert got[k].verdict == "block" and got[k].distrust == pytest.approx(0.15 * 0.85**k)


@pytest.mark.parametrize("part", ["<a ", "<a href=", '<a href="', "<a href  ", "<area title='", "<link href = //x "])
def test_links_of_broken_pages_are_found_in_one_pass(spark, part):
    import time

    page = part * ((2 << 20) // len(part)) + '><a class="y" href="//last.com/x">'
    df = spark.createDataFrame([("here.com", page)], "host string, html string")
    began = time.perf_counter()
    got = {r.dst for r in urls.links(df).collect()}
    assert time.perf_counter() - began < 20 and "last.com" in got


def test_scores_of_a_random_graph_are_those_of_power_iteration(spark):
    rng = np.random.default_rng(6)
    n = 40
    counts = np.where(rng.random((n, n)) < 0.08, rng.integers(1, 4, (n, n)), 0)
    np.fill_diagonal(counts, 0)
    name = [f"h{i}.{'net' if i < 3 else 'org' if i < 8 else 'com'}" for i in range(n)]
    page = ["".join(f'<a x href="https://{name[j]}/p">' * int(counts[i, j]) for j in range(n)) for i in range(n)]
    rows = [(i, f"http://{name[i]}/{'fr/' if 3 <= i < 8 else ''}", page[i]) for i in range(n)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}

    def power(weights, seeds):
        share = weights / np.maximum(weights.sum(1, keepdims=True), 1)
        seed = seeds / seeds.sum()
        score = seed
        for _ in range(500):
            score = 0.15 * seed + 0.85 * share.T @ score
        return score

    trust = power(counts, np.array([3.0 * 0 + (3 <= i < 8) for i in range(n)]))
    distrust = power(counts.T, np.array([float(i < 3) for i in range(n)]))
    for i in range(n):
        assert got[i].trust == pytest.approx(trust[i], abs=1e-5) and got[i].distrust == pytest.approx(distrust[i], abs=1e-5)
        want = "block" if i < 3 else "allow" if i < 8 else "block" if distrust[i] > max(trust[i], 1e-3 / n) else "allow"
        assert got[i].verdict == want
    assert sum(r.verdict == "block" for r in got.values()) > 5


def test_hosts_paths_and_rules_are_those_of_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = con.execute(r"""
        WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                          coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
             rules(h, x) AS (VALUES ('net', '/'), ('example.net', '/en/'), ('example.com', '/de/'), ('org', '/fr/')),
             f AS (SELECT page_id, h || x AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(h || x) DESC) AS k
                   FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, x))
        SELECT p.page_id, host, path, rule FROM p LEFT JOIN f ON f.page_id = p.page_id AND k = 1""").fetchall()
    got = [tuple(r) for r in urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len({r[3] for r in got}) > 2


def test_verdicts_do_not_depend_on_how_many_hosts_there_are(spark):
    rows = [(1, "http://bad.net/", ""), (2, "http://farm.com/", '<a href="http://bad.net/">l</a>'), (3, "http://alone.com/", "")]
    often = [(10 * k + i, u.replace("://", f"://h{k}-"), h.replace("://", f"://h{k}-")) for k in range(300) for i, u, h in rows]
    got = urls.judge(spark.createDataFrame(often, "page_id long, url string, html string")).groupBy((F.col("page_id") % 10).alias("i"), "verdict").count().collect()
    assert sorted(map(tuple, got)) == [(1, "block", 300), (2, "block", 300), (3, "allow", 300)]


# Quality


def tokens(text):
    """Words as the docstring has them: letters, digits and what is beyond ASCII; East Asian characters alone; runs of other marks."""
    out, last = [], None
    for c in (text or ""):
        c = c.lower() if c.isascii() else c
        kind = "east" if len(c.encode()) == 3 and 0xE3 <= c.encode()[0] <= 0xED else "word" if not c.isascii() or c.isalnum() else None if ord(c) <= 32 or ord(c) == 127 else "mark"
        if kind and kind == last and kind != "east":
            out[-1] += c
        elif kind:
            out.append(c)
        last = kind
    return out


def test_words(texts):
    import pyarrow as pa

    column = pa.array([*texts, "漢字かなx1漢 한국!!?a", "Ünï-cödé ... ", "\t a\nb  "])
    words, owner = quality.sequences(column)
    for i, text in enumerate(column.to_pylist()):
        own, want = words[owner == i], tokens(text)
        assert len(own) == (len(want) + 2 if want else 0)
        if want:
            assert own[0] == quality.START and own[-1] == quality.END
            assert len(set(own[1:-1].tolist())) == len(set(want)) and [want.index(w) for w in want] == [own[1:-1].tolist().index(h) for h in own[1:-1].tolist()]


def kneser_ney(texts):
    """P(word, context) of the interpolated modified Kneser-Ney model of pairs, by the book."""
    c = collections.Counter()
    for t in texts:
        w = ["<s>", *tokens(t), "</s>"]
        if len(w) > 2:
            c.update(zip(w[:-1], w[1:], strict=True))
    before = collections.Counter(w for _, w in c)

    def discounts(counts):
        size = collections.Counter(counts.values())
        n1, n2, n3, n4 = (size[i] for i in (1, 2, 3, 4))
        if not (n1 and n2 and n3 and n4):
            return [0, 0.5, 0.75, 0.9]
        y = n1 / (n1 + 2 * n2)
        return [0, *(min(max(x, 0.01), i) for i, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))]

    d, e = discounts(c), discounts(before)
    total, rest = sum(before.values()), sum(e[min(n, 3)] for n in before.values())
    all_, off = collections.Counter(), collections.Counter()
    for (v, _), n in c.items():
        all_[v] += n
        off[v] += d[min(n, 3)]

    def p(w, v):
        low = (before[w] - e[min(before[w], 3)]) / total + rest / total / (len(before) + 1)
        return (c[v, w] - d[min(c[v, w], 3)]) / all_[v] + off[v] / all_[v] * low if v in all_ else low

    return p


@pytest.mark.parametrize(("share", "passes"), [(1e-4, 2), (0.02, 1), (0.02, 3), (2.0, 2)])
def test_perplexity_is_of_the_interpolated_modified_kneser_ney_model(spark, docs, texts, monkeypatch, share, passes):
    monkeypatch.setattr(quality, "CHUNK", 4000)
    monkeypatch.setattr(quality, "MOST", 300)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60)] + [(61, 0), (None, 1)], "doc_id long, quality int")
    rows = quality.judge(docs, labels, passes=passes, share=share).collect()
    assert len(rows) == len(texts)
    held = {r.doc_id for r in rows if r.held_out}
    assert 3 < len(held) < 30 and held < set(range(60))
    p = kneser_ney([texts[i] for i in range(60) if i not in held])
    for r in rows:
        w = ["<s>", *tokens(texts[r.doc_id]), "</s>"]
        assert r.n_words == len(w) - 2 and (r.perplexity is None) == (len(w) == 2)
        if len(w) > 2:
            bits = sum(np.log2(p(b, a)) for a, b in zip(w[:-1], w[1:], strict=True)) / (len(w) - 1)
            assert np.log2(r.perplexity) == pytest.approx(-bits, abs=1e-4)
    worst = max(r.perplexity for r in rows if r.held_out and r.perplexity)
    assert all(r.threshold == pytest.approx(worst) for r in rows if r.perplexity) and all(r.keep == (r.perplexity is not None and r.perplexity <= r.threshold) for r in rows)


def test_quality_cases(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10, 60)] + [(20, 0, 0), (999, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    plain = docs.select("doc_id", "text", "lang", F.lit("clash").alias("hash"))
    nameless = plain.where("doc_id IN (1, 16)").withColumns({"doc_id": F.lit(None).cast("long"), "lang": F.lit(None).cast("string")})
    twice = plain.unionByName(plain.where("doc_id IN (15, 30)")).unionByName(nameless)
    rows = quality.judge(twice, labels).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count() + 4 and got[0].perplexity is None and not got[0].keep and not got[1].keep
    assert len({(r.doc_id, r.perplexity, r.keep) for r in rows if r.doc_id in (15, 30)}) == 2
    learned = [r for r in rows if r.doc_id is not None and 10 <= r.doc_id < 60]
    assert sum(r.keep for r in learned) >= 0.95 * len(learned) and sum(r.held_out for r in learned) > 0
    assert quality.judge(none, labels).count() == 0
    assert all(r.keep == (r.n_words > 0) for r in quality.judge(docs, labels.limit(0)).collect())


# Language


def test_language(spark, sf_dir):
    from quarry.sources.tables import table

    docs = table(spark, sf_dir, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.digest(docs).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows) and len(held) > 20
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) >= 0.97


def test_votes_of_fixed_weights():
    """Family first, then one vote a pair within it; ties by the sum of margins, then the first language."""
    model = language.Model.__new__(language.Model)
    model.languages = ["da", "de", "es", "fr", "sv"]
    model.families = sorted({language.family_of(v) for v in model.languages})
    model.family_row = {f: i for i, f in enumerate(model.families)}
    own = {f: [v for v in model.languages if language.family_of(v) == f] for f in model.families}
    pairs = [(a, b) for f in model.families for i, a in enumerate(own[f]) for b in own[f][i + 1 :]]
    model.pair_row = {p: len(model.families) + i for i, p in enumerate(pairs)}
    rng = np.random.default_rng(3)
    margins = rng.normal(size=(400, len(model.families) + len(pairs)))
    best, score = model.decide(margins)
    assert len(model.families) > 1 and len(pairs) > 2
    for row, b, s in zip(margins, best, score, strict=True):
        family = model.families[int(np.argmax(row[: len(model.families)]))]
        votes, sums, least = collections.Counter(), collections.Counter(), [row[model.family_row[family]]]
        for (x, y), k in model.pair_row.items():
            if language.family_of(x) == family:
                votes[x if row[k] >= 0 else y] += 1
                sums[x] += row[k]
                sums[y] -= row[k]
                least.append(abs(row[k]))
        assert model.languages[b] == max(own[family], key=lambda v: (votes[v], sums[v]))
        sure = min(least[0], min(least[1:], default=least[0]))
        assert s == pytest.approx(1 / (1 + np.exp(-3 * sure)))


def test_language_cases(spark, sf_dir, none):
    from quarry.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", "en"), (1003, "The thing and other", None), (1003, "The thing and other", None)], docs.schema)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.digest(docs.unionByName(odd)).where("doc_id >= 1000").collect()]
    assert sorted(g[:2] for g in got) == [(1000, "und"), (1001, "und"), (1002, "und"), (1003, "en"), (1003, "en")]
    assert {r.lang_pred for r in language.digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.lang_pred for r in language.digest(docs.where("lang = 'de'")).collect()} == {"de"}
    assert language.digest(none).count() == 0


def test_topk_of_repeated_rows_and_several_dimensions(spark):
    rows = [(0, [1.0]), (0, [1.0]), (8, [3.0]), (7, [2.0]), (7, [2.0]), (6, [9.0, 9.0]), (50, [1.0, 0.0]), (100, [1.0] * 3), (0, None)]
    got = sorted(tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5, 1, 2, 1).collect())
    mine = [(0, 1, 8, 3 << 16), (0, 2, 7, 2 << 16), (0, 3, 7, 2 << 16), (0, 4, 0, 1 << 16)]
    assert got == sorted(mine * 2 + [(50, 1, 6, 9 << 16)])
