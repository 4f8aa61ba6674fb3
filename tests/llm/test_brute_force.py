"""The ten operators and the pipeline's stages against brute force, round trips or held-out accuracy."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
import public_tokenizers as public
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL, rows_of
from driftline.llm import ann, bpe, catalog, components, dartminhash, langid, linedup, packing, quality, sharding

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    assert rows_of(catalog.queries()[name](spark, SMALL).toPandas()) == rows_of(duck.sql(catalog.oracle_sql()[name]).df())


def test_op1_recall(spark):
    got = defaultdict(list)
    for r in catalog.op1_learned_partitions(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, x = e["vec_id"].to_numpy(), np.vstack(e["embedding"]).astype(float)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        found = got[ids[q]]
        assert len(found) == 20 and found == sorted(found, key=lambda v: (-v[1], v[0]))
        assert all(abs(score - x[np.flatnonzero(ids == v)[0]] @ x[q]) < 1e-12 for v, score in found)
        hit, total = hit + len({v for v, _ in found} & set(want)), total + 20
    assert hit / total >= 0.9


def test_op1_parts_are_balanced():
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(8, 16))
    x = np.vstack([c + 0.1 * rng.normal(size=(100, 16)) for c in centre])
    near = ann.neighbours(x, 10)
    label = ann.refine(near, ann.bisect_balanced(x, 8, rng), 8)
    assert np.bincount(label, minlength=8).max() <= 105
    _, probes = ann.fit_router(x, 8, 0.97, 10)
    assert probes <= 3


def test_op2_suffix_ranks_order_suffixes(spark):
    """Ranks against sorted suffixes of random line sequences."""
    rnd = random.Random(3)
    rows, words = [], {}
    for d in range(12):
        seq = [rnd.randrange(3) for _ in range(rnd.randrange(1, 9))]
        words[d] = seq
        rows += [(d, 0, 0, i, x, -x) for i, x in enumerate(seq)]
    s = spark.createDataFrame(rows, "doc_id long, h long, seg long, line long, a long, b long")
    got = {(r["doc_id"], r["line"]): (r["a"], r["o2"]) for r in linedup.suffix_ranks(s, 2)[0].collect()}
    cut = {(d, i): tuple(seq[i : i + 4]) for d, seq in words.items() for i in range(len(seq))}
    keys = list(cut)
    for x in keys:
        for y in keys:
            assert (got[x] == got[y]) == (cut[x] == cut[y])
            if cut[x][0] == cut[y][0]:
                assert (got[x][1] < got[y][1]) == (cut[x] < cut[y])


def test_op2_longest_later_runs(spark):
    """The longest run that has been before, of every suffix of random segments, and where it was first."""
    rnd = random.Random(4)
    seqs = {(d, s): [rnd.randrange(2) for _ in range(rnd.randrange(1, 24))] for d in range(9) for s in range(rnd.randrange(1, 3))}
    rows = [(d, 0, 100 * s, 100 * s + i, x, -x, 1) for (d, s), seq in seqs.items() for i, x in enumerate(seq)]
    state = spark.createDataFrame(rows, "doc_id long, h long, seg long, line long, a long, b long, w long")
    got = {(r["doc_id"], r["line"]): (r["n"], (r["first"]["doc_id"], r["first"]["line"]) if r["first"] else None) for r in linedup.later_runs(state).collect()}
    tails = sorted((d, 100 * s + i, tuple(seq[i:])) for (d, s), seq in seqs.items() for i in range(len(seq)))
    for i, (d, line, x) in enumerate(tails):
        n, first = 0, None
        for e, at, y in tails[:i]:
            same = next((j for j, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            if same > n:
                n, first = same, (e, at)
        assert got[d, line] == (n, first)


def test_op2_maximal_runs(spark):
    a, b = [f"line {i} of the shared passage" for i in range(12)], ["something else entirely here"]
    texts = {1: a + b, 2: b + a[2:9] + ["own"], 3: a[4:] + ["mine"], 4: a + b}
    d = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {(r["doc_id"], r["line"], r["n"], r["words"], r["first"]["doc_id"], r["first"]["line"]) for r in linedup.repeated_runs(d, 12).collect()}
    assert got == {(2, 1, 7, 42, 1, 2), (3, 0, 8, 48, 1, 4)}  # document 4 is a whole copy
    assert {r["doc_id"]: r["text"] for r in linedup.delete_later_copies(d, 12).collect()} == {1: "\n".join(a + b), 2: b[0] + "\nown", 3: "mine", 4: ""}


def test_op3_resampling(spark):
    scored = catalog.op3_importance_resampling(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(scored, on="doc_id")
    assert labels[labels.quality == 1].accepted.mean() > 0.98 and labels[labels.quality == 0].accepted.mean() < 0.15
    keys = np.sort(scored.gumbel_key.to_numpy())[::-1]
    k = round(0.5 * len(scored))
    assert set(scored[scored.selected].doc_id) == set(scored[scored.gumbel_key >= keys[k - 1]].doc_id)
    again = catalog.op3_importance_resampling(spark, SF).where("selected").select("doc_id").toPandas()
    assert set(again.doc_id) == set(scored[scored.selected].doc_id)


def test_op3_log_ratio_and_weights(spark):
    """Models, weights and the held-out cut against plain counts."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.fit(docs, labels, buckets=997)
    held = {r["doc_id"] for r in labels.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0).collect()}
    good_ids = {r["doc_id"] for r in labels.where("quality = 1").collect()} - held
    assert held and good_ids
    make, raw, good = quality.Features(997), np.ones(997), np.ones(997)
    for r in docs.collect():
        b = np.bincount(make(r["text"]), minlength=997)
        raw += b
        good += b * (r["doc_id"] in good_ids)
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    assert np.allclose(model.log_ratio, ratio)
    mean = {}
    for r in quality.weigh(docs, model).collect():
        b = make(r["text"])
        mean[r["doc_id"]] = ratio[b].sum() / (len(b) + quality.PRIOR)
        assert (r["__features"], r["__log_weight"]) == (len(b), pytest.approx(ratio[b].sum(), abs=1e-6))
        assert r["__accepted"] == (len(b) > 0 and mean[r["doc_id"]] >= model.cut - 1e-12)
    kind = {q: sorted(mean[r["doc_id"]] for r in labels.where(f"quality = {q}").collect() if r["doc_id"] in held and r["doc_id"] in mean) for q in (0, 1)}
    assert model.cut == pytest.approx((kind[0][-1] + kind[1][0]) / 2 if kind[0] and kind[0][-1] < kind[1][0] else kind[1][0])


def test_op3_features_are_those_of_the_whole_text():
    """Every word and every pair of neighbours counts once for each occurrence, wherever it stands."""
    make = quality.Features(1 << 17, remember=3)
    one = {w: make(w)[0] for w in "a b c d".split()}
    pair = {(x, y): make(f"{x} {y}")[2] for x in "abcd" for y in "abcd"}
    words = [random.Random(1).choice("abcd") for _ in range(5000)]
    assert Counter(make(" ".join(words)).tolist()) == Counter([one[w] for w in words] + [pair[p] for p in zip(words, words[1:])])


def test_op3_rows_equal_at_the_last_key_are_all_selected(spark):
    d = spark.createDataFrame([(1, "the same text", None)] * 5 + [(2, None, None)], "doc_id long, text string, lang string")
    got = quality.resample(d, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), share=0.34).collect()
    assert len(got) == 6 and len({r["gumbel_key"] for r in got if r["doc_id"] == 1}) == 1
    assert sum(r["selected"] for r in got) in (5, 6)  # two are asked for




def test_kth_largest(spark):
    rnd = random.Random(0)
    values = [rnd.randrange(-(10**15), 10**15) for _ in range(500)] + [7] * 50
    d = spark.createDataFrame([(v,) for v in values] + [(None,)], "k long")
    for k in (1, 2, 250, 300, 550, 900):
        assert quality.kth_largest(d, "k", k, bins=16) == sorted(values, reverse=True)[min(k, 550) - 1]
    assert quality.kth_largest(d.where("false"), "k", 3) is None


def test_op4_smallest_capacity(spark):
    """The shards against an exhaustive search, with and without groups larger than a shard should be."""
    rnd = random.Random(5)
    for shards, more in ((2, []), (5, []), (5, [9000, 4000]), (4, [9000, 9000, 9000, 50]), (3, [10**6])):
        sizes = {rnd.randrange(-(2**63), 2**63): g for g in [rnd.randrange(1, 100) for _ in range(300)] + more}
        largest, begins, firsts = sharding.minimax_partition(spark.createDataFrame(list(sizes.items()), "h long, g long"), shards)
        got = {h: largest[h] if h in largest else begins + sum(h >= f for f in firsts) for h in sizes}
        top = sorted(sizes, key=lambda h: (-sizes[h], h))[:shards]
        assert set(largest) == set(top)
        order = top + sorted(h for h in sizes if h not in set(top))

        def fill(groups, c):
            ends, at = [], 0
            for i, h in enumerate(groups):
                if sizes[h] > c:
                    return None
                if at + sizes[h] > c:
                    ends.append(i)
                    at = 0
                at += sizes[h]
            return [*ends, len(groups)]

        def least(groups, n):
            c = max(sizes[h] for h in groups)
            while len(fill(groups, c)) > n:
                c += 1
            return c

        want, at, shard = {}, 0, 0
        while at < len(order):
            left = order[at:]
            ends = fill(left, least(left, shards - shard))
            stop = 1 if 0 < ends[0] < len(left) and at + ends[0] <= len(top) and shards - shard > 1 else len(ends)
            for a, b in zip([0, *ends][:stop], ends[:stop]):
                want |= {h: shard for h in left[a:b]}
                shard += 1
            at += ends[stop - 1]
        assert got == want
        load = Counter()
        for h, k in got.items():
            load[k] += sizes[h]
        assert max(load.values()) == least(order, shards) and len(load) <= shards


def test_op4_contract(spark, texts):
    got = catalog.op4_minimax_shards(spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(texts) and got.shard.between(0, 23).all()
    for r in got.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    of = defaultdict(set)
    for r in got.itertuples():
        of[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in of.values())
    load = got.groupby("shard")["size"].sum()
    group = got.assign(t=got.doc_id.map(texts)).groupby("t")["size"].sum()
    assert load.max() <= load.sum() / 24 + group.max()


def test_op5_every_token_once(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    got = catalog.op5_packing(spark, SF).toPandas()
    for doc_id, g in got.sort_values("start").groupby("doc_id"):
        ids = np.array(tok.encode(texts[doc_id], add_special_tokens=False).ids + [2], dtype="<u4")
        at = 0
        for r in g.itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= 1.01 * (got.length.sum() / 4096) + 1


def test_op5_ids_equal_the_tokenizers(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rnd = random.Random(9)
    parts = ["<|startoftext|>", "<|endoftext|>", "<|EndOfText|>", "<|", "|>", "the", "It's", " ", "\n", "1", "é", "日本", "x_y", "E\u0301", "\x85", "ſ", "İ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(3000)]
    words = packing.WordTokens(tok.to_str(), remember=50)
    for t in texts:
        assert np.frombuffer(words.ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_op5_words_in_use_are_tokenised_once(monkeypatch):
    """A word that every text has is tokenised once, however often the memory of words is full; plain texts,
    contractions and special strings have the tokenizer's ids."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    words, seen = packing.WordTokens(tok.to_str(), remember=20), Counter()
    model = words.model
    monkeypatch.setattr(words, "model", SimpleNamespace(tokenize=lambda w: seen.update([w]) or model.tokenize(w)))
    for i in range(200):
        t = f"usual Fran\xe7ais w{''.join(chr(97 + int(c)) for c in str(i))} it's ''s we'll _{i}_ x\ufffey\n<|endoftext|> usual"
        for part in (t, t[: t.index(" x")]):
            assert np.frombuffer(words.ids(part), "<u4").tolist() == tok.encode(part, add_special_tokens=False).ids, part
    assert seen["usual"] == 1


def test_op5_histogram_packing_equals_one_by_one():
    rnd = random.Random(1)
    for _ in range(30):
        lengths = [rnd.randrange(1, 40) for _ in range(rnd.randrange(1, 200))]
        patterns = packing.pack_histogram(Counter(lengths), 50)
        used = Counter()
        for packs, items in patterns:
            assert sum(n * t for n, t in items) <= 50
            for n, t in items:
                used[n] += packs * t
        assert used == Counter(lengths)
        packs = []  # shortest pack first, document by document
        for n in sorted(lengths, reverse=True):
            fit = [i for i, p in enumerate(packs) if p + n <= 50]
            if fit:
                packs[min(fit, key=lambda i: packs[i])] += n
            else:
                packs.append(n)
        assert sum(p for p, _ in patterns) == len(packs)


def _near_classes(texts):
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        times = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()
        sets[i] = {(x, k) for x, n in times.items() for k in range(n)}  # a shingle weighs as often as it occurs
    inverse, shared, parent = defaultdict(list), Counter(), {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for s in sets[i]:
            for j in inverse[s]:
                shared[j, i] += 1
            inverse[s].append(i)
    for (a, b), c in shared.items():
        if c >= 0.8 * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_op6_classes(spark, texts):
    got = {r["doc_id"]: r["class_id"] for r in catalog.op6_dart_minhash(spark, SF).collect()}
    assert got == _near_classes(texts)


def test_op6_large_groups_of_near_copies(spark):
    """Copies with few and with many edits, few of which are near enough to their base."""
    rnd = random.Random(8)
    texts = {}
    for g in range(2):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice((70, 90)))]
        for i in range(300):
            t = list(base)
            for _ in range(rnd.choice((0, 1, 2, 3, 4, 6, 9))):
                at = rnd.randrange(len(t))
                t[at : at + rnd.choice((0, 1, 1, 1))] = [f"e{rnd.randrange(4)}"]
            texts[1000 * g + i] = " ".join(t)
    texts |= {5000 + i: "again and again the same " * i + "end" for i in range(1, 30)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicate_classes(d, bands=80, rows=3).collect()}
    want = _near_classes(texts)
    assert len(set(want.values())) > 50 and got == want


def test_op6_null_ids_tell_classes_apart(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    got = dartminhash.near_duplicate_classes(spark.createDataFrame([(None, a), (None, a), (None, b), (None, b)], "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {None} and len({r["class_hash"] for r in got}) == 2 and {r["class_size"] for r in got} == {2}


def test_op6_sketches_estimate_weighted_similarity():
    r = np.random.default_rng(4)
    e = r.integers(0, 2**63, 60).astype(np.uint64)
    a, b = r.random(60) * 4 + 0.05, r.random(60) * 4 + 0.05
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    seen = np.mean([(dartminhash.sketch(e + np.uint64(i), 128, a) == dartminhash.sketch(e + np.uint64(i), 128, b)).mean() for i in range(40)])
    assert abs(seen - want) < 0.03


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["v"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {x: got.get(x, x) for x in parent} == {x: find(x) for x in parent}


def test_op7_contract(spark, texts):
    got = {r["doc_id"]: r for r in catalog.op7_winnowing(spark, SF).collect()}
    order = sorted(texts)
    plain = lambda f: {int(x.split("@")[0], 16) for x in f.split()}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    by_text = {}
    for i, d in enumerate(order):
        r, t, nxt = got[d], texts[d], texts[order[(i + 1) % len(order)]]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert r["near_edited"] == pytest.approx(like(plain(r["fingerprint"]), plain(r["edited_fingerprint"])))
        assert r["near_next"] == pytest.approx(like(plain(r["fingerprint"]), plain(got[order[(i + 1) % len(order)]]["fingerprint"])))
    long = [r for r in got.values() if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] for r in long]) > 0.5 > np.mean([r["near_next"] for r in long])


def _units(text):
    import regex

    return regex.findall(r"[a-z0-9\u00c0-\u024f\u0300-\u0dff\u10a0-\u177f\u1800-\u1fff]{1,16}|[^\s\p{Z}]", text.lower())


def test_op7_windows(spark, texts):
    """Chosen grams against a plain scan, on gram hashes that are rolled from unit to unit."""
    from driftline.llm import winnow

    some = [t for t in list(texts.values())[:60]] + ["a a a a a a a a a a a a a a", "one two", "吾輩は猫である。名前はまだ無い。どこで生れたか", "x=1;y=2;if(x<y){z(x);}" * 9, "a" * 400]
    units = {t: _units(t) for t in some}
    words = sorted({u for us in units.values() for u in us})
    hash_of = {r["w"]: r["h"] & 2**64 - 1 for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    turn = lambda x, n: (x << n | x >> 64 - n) & 2**64 - 1
    d = spark.createDataFrame([(t,) for t in some], "t string")
    every = d.select("t", winnow.chosen(F.col("t"), 5, 1).alias("all"), winnow.chosen(F.col("t"), 5, 8).alias("some")).collect()
    for r in every:
        grams = sorted((x for x in r["all"]), key=lambda x: (1 << 31) - 1 - (x & (1 << 31) - 1))
        h = [hash_of[u] for u in units[r["t"]]]
        assert len(grams) == max(1, len(h) - 4)
        if len(h) >= 5:
            x = 0
            for i, y in enumerate(h):
                x = turn(x, 1) ^ y ^ (turn(h[i - 5], 5) if i >= 5 else 0)
                assert i < 4 or grams[i - 4] >> 31 == x >> 32
        want = []
        for i in range(max(1, len(grams) - 7)):
            least = min(x >> 31 for x in grams[i : i + 8])
            pick = [x for x in grams[i : i + 8] if x >> 31 == least][-1]
            if not want or want[-1] != pick:
                want.append(pick)
        assert r["some"] == want


def test_op7_guarantee_without_blanks(spark):
    """Twelve units in common, in texts without blanks too, are a chosen gram in common."""
    from driftline.llm import winnow

    rnd = random.Random(11)
    for letters in ("的一是不了人我在有他这为之大来以个中上们", "abc(){};=+-_.,"):
        text = lambda n: "".join(rnd.choice(letters) for _ in range(n))
        common = "".join(rnd.choice(letters[-8:]) for _ in range(14))
        rows = [(text(rnd.randrange(40)) + ";" + common + ";" + text(rnd.randrange(40)),) for _ in range(20)]
        got = [set(r["h"]) for r in spark.createDataFrame(rows, "t string").select(winnow.hashes(winnow.chosen(F.col("t"))).alias("h")).collect()]
        assert all(a & b for a in got for b in got)


@pytest.fixture(scope="module")
def vocabulary():
    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return bpe.Vocabulary.read(f.read())


def test_op8_equals_tiktoken(spark, texts):
    import tiktoken

    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in catalog.op8_byte_bpe(spark, SMALL).collect():
        t = spark.read.parquet(f"{SMALL}/documents.parquet").where(F.col("doc_id") == r["doc_id"]).first()["text"] if r["doc_id"] < 3 else None
        if t is not None:
            ids = enc.encode_ordinary(t)
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    encoder = bpe.Encoder(bpe.Vocabulary(ranks), public.PATTERN, remember=500)
    rnd = random.Random(6)
    odd = ["", " ", "  a   b \n\n c ", "x\n \ny", "a \n ", "it's 's WE'LL 12 12.5%", "日本語 한국어 🙂🤷🏽‍♂️", "a" * 400, " x  y\x85z\x1c"]
    odd += ["".join(rnd.choice(" \n\tabe'st.,1é日 ") for _ in range(rnd.randrange(60))) for _ in range(1500)] + list(texts.values())[:150]
    for t in odd:
        ids = encoder.encode(t)
        assert ids == enc.encode_ordinary(t) and encoder.decode(ids) == t.encode()


def test_op8_appends_and_edits(vocabulary):
    rnd = random.Random(7)
    for _ in range(300):
        t = bytes(rnd.choice(b"abcdefthein ") for _ in range(rnd.randrange(1, 120)))
        k = rnd.randrange(len(t) + 1)
        table = bpe.PrefixTable(vocabulary, t[:k])
        table.append(t[k:])
        assert table.last == bpe.PrefixTable(vocabulary, t).last
        a = rnd.randrange(len(t) + 1)
        b = min(len(t), a + rnd.randrange(6))
        new = bytes(rnd.choice(b"the xyz") for _ in range(rnd.randrange(6)))
        table.replace(a, b, new)
        assert table.text == t[:a] + new + t[b:] and table.last == bpe.PrefixTable(vocabulary, table.text).last
        assert b"".join(vocabulary.bytes_of[i] for i in table.tokens()) == table.text
    whole = bpe.PrefixTable(vocabulary, b"the quick brown fox " * 500)
    assert whole.replace(40, 41, b"x") < 1000


def test_op9_held_out_accuracy(spark):
    got = catalog.op9_language(spark, SF)
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(lang, "doc_id")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_op9_letters_by_category():
    m = langid.WordBackoff({"a": {"zebra": 5}, "b": {"house": 9}})
    assert langid.Scorer(m).batch(["½ ²", "①②", "Ⅷ", "٣", "_", "\u0301", "日", "x²"])[0][:6] == ["und"] * 6
    assert "und" not in langid.Scorer(m).batch(["日", "x²", "ß"])[0]


def test_op9_scores_against_a_plain_version(spark):
    """Predictions and scores of a table against word by word scoring; few words are remembered."""
    import regex

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs)
    scorer = langid.Scorer(model, remember=40)
    texts = [r["text"] for r in docs.collect()] + ["zzqx wvvk", None, "12", "été½naïve x²y ①word Ⅷ und_er 日本語テキスト"]
    half = [t[: len(t) // 2] + "q" + t[len(t) // 2 :] if t else t for t in texts]
    for some in (texts, half):
        for (text, lang, score) in zip(some, *scorer.batch(some)):
            words = regex.findall(r"\p{L}+", text.lower()) if text else []
            if not words:
                assert (lang, score) == ("und", 0.0)
                continue
            rows = [model.table[model.rows[w]] if w in model.rows else u if (u := model.unseen(w)) is not None else np.zeros(len(model.langs)) for w in words]
            mean = np.mean(rows, axis=0)
            share = np.exp(mean) / np.exp(mean).sum()
            assert score == pytest.approx(share.max()) and share[model.langs.index(lang)] == pytest.approx(share.max())
            at, table = model.grams[3]
            three = [f"^{w}$"[i : i + 3] for w in words for i in range(len(w))]
            mean = np.mean([table[at[g]] if g in at else model.threes[-1] for g in three], axis=0)
            assert [scorer.fit(text, x) for x in model.langs] == pytest.approx(list(mean))


def test_op9_backs_off_to_shorter_grams():
    m = langid.WordBackoff({"a": {"zebra": 5, "xylo": 2}, "b": {"house": 9}})
    s = langid.Scorer(m)
    assert s.batch(["zebra", "zebras", "houses", "x", "12", None])[0] == ["a", "a", "b", "a", "und", "und"]
    assert m.unseen("日") is None or len(m.unseen("日")) == 2


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain version of itself, on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(before)
            break
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
        assert all(n == len(t) for t, n in after.values())
        if name == "language":
            assert set(after) == set(before)  # every text of this table is in one of its languages
        elif name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            good = [i for i in before if labels.get(i) == 1]
            assert sum(i in after for i in good) >= 0.99 * len(good)
        elif name == "line_dedup":
            assert {i: t for i, (t, _) in after.items()} == _without_repeats(before, 50)
        elif name == "near_dedup":
            classes = _near_classes(before)
            assert set(after) == {min(c for c in classes if classes[c] == k) for k in set(classes.values())}
        docs = out


FOREIGN = {
    "Italian": "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura. Il governo ha annunciato oggi nuove misure per sostenere le famiglie e le imprese.",
    "Polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Wczoraj wieczorem padał deszcz, więc zostaliśmy w domu.",
    "Finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Eilen illalla satoi vettä, joten jäimme kotiin.",
    "Dutch": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Gisteravond regende het, dus bleven we thuis en keken we naar een oude film.",
    "code": "parser = argparse.ArgumentParser(); args = parser.parse_args(argv); for idx, row in enumerate(csv.reader(open(args.path))): logger.debug(row)",
    "base64": "TG9yZW0gaXBzdW0gZG9sb3Igc2l0IGFtZXQ gY29uc2VjdGV0dXIgYWRpcGlzY2luZyBlbGl0 c2VkIGRvIGVpdXNtb2QgdGVtcG9y",
    "mashing": "asdkfj qwoeiu zxmcnv aslkdjf qpwoei zmxnb alskd fjgh qwpoeir zxcvmn lkjasd poiuqw mnbzxc",
}


def test_pipeline_language_rejects_foreign_and_gibberish(spark):
    rnd = random.Random(3)
    planted = list(FOREIGN.values()) + [" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 10))) for _ in range(30)) for _ in range(50)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # labelled, so that the model learns from them too
    more = spark.createDataFrame([(-1 - i, t, ("en", "es", "de", "fr")[i % 4], "planted", len(t)) for i, t in enumerate(planted)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(more), SF).select("doc_id").collect()}
    assert not {i for i in kept if i < 0}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}


def _without_repeats(texts, words):
    """Every line run of enough words, at every place: later copies of a run seen before go."""
    seen, gone = {}, defaultdict(set)
    for pass_ in (0, 1):
        for d in sorted(texts):
            lines = [x.strip(" ") for x in texts[d].split("\n")]
            w = [len(x.split()) for x in lines]
            for i in range(len(lines)):
                total = 0
                for j in range(i, len(lines)):
                    total += w[j]
                    if total >= words:
                        run = tuple(lines[i : j + 1])
                        if pass_ == 0:
                            seen.setdefault(run, (d, i))
                        elif seen[run] < (d, i):
                            gone[d].update(range(i, j + 1))
    kept = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]) for d, t in texts.items()}
    return {d: t for d, t in kept.items() if t.strip()}
