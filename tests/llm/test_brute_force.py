"""Brute-force twins of the operators on small or odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from hypothesis import given, settings, strategies as st

from carespark.llm import fingerprints, langid, licenses, mixing, packing, quality, simhash, topk, toxicity, url_rules
from carespark.llm.queries import tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def texts_by_id(docs):
    return sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=repr)


# --- packing ---------------------------------------------------------------------


@given(st.lists(st.integers(1, 700), max_size=60), st.sampled_from([16, 64, 256]))
@settings(max_examples=60, deadline=None)
def test_pieces_tile_items_and_fill_sequences(lengths, sequence):
    pieces = packing.assign(lengths, sequence)
    used = defaultdict(list)
    for n, own in zip(lengths, pieces):
        at = 0
        for start, part, s, offset in sorted(own):
            assert start == at and 0 < part <= sequence
            at += part
            used[s].append((offset, part))
        assert at == n
    sizes = []
    for parts in used.values():
        at = 0
        for offset, part in sorted(parts):
            assert offset == at
            at += part
        sizes.append(at)
    assert all(n & (n - 1) == 0 for n in sizes)
    assert sum(n < sequence for n in sizes) <= sequence.bit_length()


def test_cheapest_sequence_gets_the_next_item():
    pieces = packing.assign([40, 30, 20, 20, 10, 8], 64)
    first = {s for own in pieces[:2] for _, _, s, _ in own}
    assert len(first) == 2  # the second longest goes to the empty one


@given(st.text(alphabet=st.characters(max_codepoint=0x17F), max_size=60))
@settings(max_examples=200, deadline=None)
def test_encoder_equals_the_tokenizer(text):
    whole = Tokenizer.from_file(tokenizer_path())
    words = packing.encoder(tokenizer_path())
    assert np.frombuffer(words.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pack_round_trip(odd_docs, no_docs):
    whole = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(odd_docs, tokenizer_path(), block_tokens=5000).collect()
    ids = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        part = np.frombuffer(r["ids"], "<u4")
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(part) == r["length"]
        ids[r["doc_id"]].append((r["start"], part.tolist(), r["doc_tokens"]))
    want = defaultdict(list)
    for i, text in texts_by_id(odd_docs):
        want[i].append(whole.encode(text, add_special_tokens=False).ids + [1])
    for i, lists in want.items():
        assert sum(len(p) for _, p, _ in ids[i]) == sum(map(len, lists))
        got = [x for _, p, _ in sorted(ids[i]) for x in p]
        assert Counter(got) == Counter(x for own in lists for x in own)
        if len(lists) == 1:
            assert got == lists[0] and all(n == len(got) for _, _, n in ids[i])
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


# --- exact top-k -----------------------------------------------------------------


def brute_top(rows, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("span", [3, 40, 10**7])
def test_top_k_equals_brute_force(spark, span):
    rnd = random.Random(span)
    width = 6
    rows = [(i, [rnd.randint(-span, span) // rnd.choice([1, 1, 7]) for _ in range(width)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    wanted = df.where("vec_id % 20 = 0")
    got = topk.top_k(df, wanted, 5, row_block=64, query_block=7)
    queries = [r for r in rows if r[0] % 20 == 0]
    assert sorted(map(tuple, got.collect())) == brute_top(rows, queries, 5)


def test_reading_stops_on_proof():
    values = np.vstack((np.full((40, 4), 1), np.full((5, 4), 64)))
    index = topk.ImpactIndex(values)
    rows, scores = index.search(np.array([[3, 3, 3, 3]]), 5, np.array([-1]))
    assert set(range(40, 45)) <= set(rows[0].tolist()) and len(rows[0]) < 45
    assert scores[0].max() == 768


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.01]), (20, [0.5]), (1, None), (2, [nan, 1.0]), (3, [inf]), (4, [None, 1.0]), (None, [1.0]), (5, []), (20, [0.25])]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted((r["vec_id"], r["v"]) for r in df.collect()) == [(0, [64, -1]), (5, []), (20, [16])]
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 20).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 20, 1024), (0, 2, 5, 0), (20, 1, 0, 1024), (20, 2, 5, 0)]
    assert topk.top_k(df.limit(0), df.limit(0), 20).count() == 0


# --- language --------------------------------------------------------------------


def brute_ngrams(text):
    plain = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    plain = re.sub(" +", " ", plain)
    return [plain[i:i + n] for n in langid.ORDERS for i in range(len(plain) - n + 1)]


@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_ngrams_do_not_span_texts(texts):
    joint = langid.ngram_buckets(texts)
    for i, text in enumerate(texts):
        alone = langid.ngram_buckets([text])
        assert sum(int(e[0] - b[0]) for _, b, e in alone) == len(brute_ngrams(text))
        for (h, b, e), (h1, b1, e1) in zip(joint, alone):
            assert h[b[i]:e[i]].tolist() == h1[b1[0]:e1[0]].tolist()


def test_language_model_equals_plain_naive_bayes(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    assert model.langs == ["en", "fr"]
    counts = {x: Counter() for x in model.langs}
    docs = Counter()
    for r in odd_docs.collect():
        if r["lang"] is not None:
            docs[r["lang"]] += 1
            for h, b, e in langid.ngram_buckets([r["text"] or ""]):
                counts[r["lang"]].update(h[b[0]:e[0]].tolist())
    for i, x in enumerate(model.langs):
        total = sum(counts[x].values()) + langid.SMOOTHING * (1 << langid.BITS)
        want = np.log((np.array([counts[x][j] for j in range(1 << langid.BITS)]) + langid.SMOOTHING) / total)
        assert np.allclose(model.logp[i], want, atol=1e-5)
        assert math.isclose(model.prior[i], math.log(docs[x] / sum(docs.values())))
    found = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(odd_docs, model).collect()}
    assert {i for i, x, _ in found if x == "und"} == {2, 3, 7}
    assert all(0 <= s <= 1 for _, _, s in found)
    empty = langid.fit(no_docs)
    assert langid.identify(odd_docs.where("doc_id = 8"), empty).first()["lang_pred"] == "und"
    assert langid.identify(no_docs, model).count() == 0


# --- order MinHash ---------------------------------------------------------------


def brute_order_minhash(text):
    points = np.array([ord(c) for c in text], dtype=np.uint64)
    kmers = fingerprints.numbered_kmers(points)
    out = []
    for odd in fingerprints._ODD[:, 0]:
        small = [(int((int(x) >> 32) * int(odd) & 0xFFFFFFFF), i) for i, x in enumerate(kmers)]
        picked = sorted(i for _, i in sorted(small)[: fingerprints.PICKS])
        total = sum(int(kmers[i]) * int(w) for i, w in zip(picked, fingerprints._PAIR)) + len(picked)
        out.append(int(fingerprints._mix(np.array([total & (1 << 64) - 1], dtype=np.uint64))[0] >> np.uint64(32)))
    return out


@pytest.mark.parametrize("text", ["a", "short", "exactly8", "ab" * 50, "the quick brown fox " * 9, "x" * 5000 + "yz" * 4000])
def test_order_minhash_equals_brute_force(text):
    assert fingerprints.order_minhash(text).tolist() == brute_order_minhash(text)


def test_occurrences_are_numbered():
    points = np.array([ord(c) for c in "abcdefgh" * 4], dtype=np.uint64)
    assert len(set(fingerprints.numbered_kmers(points).tolist())) == len(points) - fingerprints.K + 1


def test_order_matters():
    words = [f"w{i:05d} " for i in range(400)]
    a = fingerprints.order_minhash("".join(words))
    moved = fingerprints.order_minhash("".join(words[200:] + words[:200]))
    small = fingerprints.order_minhash("".join(words[:390] + ["other "] + words[390:]))
    assert fingerprints.likeness(a, small) > 0.8 > fingerprints.likeness(a, moved)


@pytest.mark.parametrize("bucket_rows", [2, 100])
def test_neighbours(spark, odd_docs, no_docs, bucket_rows):
    ordered = sorted(
        ((-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["text"] or "", r["doc_id"]) for r in odd_docs.collect()),
    )
    want = []
    for (_, text, i), (_, after, _) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = map(fingerprints.order_minhash, (text, edited, after))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.hexadecimal(a),
                     fingerprints.hexadecimal(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    got = fingerprints.neighbour_fingerprints(odd_docs, bucket_rows).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert fingerprints.neighbour_fingerprints(no_docs).count() == 0
    assert fingerprints.add_fingerprints(odd_docs).count() == odd_docs.count()


def test_neighbours_of_one_id_are_divided(spark):
    """Half of the rows have no id, a third share one id: their buckets stay near an even share, results are whole."""
    rnd = random.Random(4)
    ids = [None] * 300 + [7] * 200 + rnd.sample(range(-50, 900), 100)
    rows = [(i, f"{rnd.random()} text {n % 290}") for n, i in enumerate(ids)] + [(7, "same")] * 5 + [(None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = fingerprints.neighbour_buckets(docs, 40).collect()
    sizes = Counter(r["bucket"] for r in placed if not r["guard"])
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) <= 3 * 40
    ordered = sorted(
        ((-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["h"], r["text"] or "", r["doc_id"])
         for r in docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()),
        key=lambda r: r[:3],
    )
    want = []
    for (*_, text, i), (*_, after, _) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        want.append((i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    got = fingerprints.neighbour_fingerprints(docs, 40).select("doc_id", "n_chars", "edited_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(want)


# --- url rules -------------------------------------------------------------------


def brute_judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [
        (len(h) + len(p), len(h), v, h + p)
        for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    _, _, verdict, rule = max(fit, default=(0, 0, "allow", None))
    return host, path, rule, verdict


def test_url_rules_equal_brute_force(spark):
    rnd = random.Random(3)
    hosts = ["org", "example.org", "a.example.org", "xexample.org", "com", "b.com", "EXAMPLE.org", "a..org", "org.", "é.com"]
    paths = ["", "/", "/es", "/es/1", "/es/12", "/en/1", "/en/19?x=/es/", "/fr/#a", "/~", "/\U0010ffff/z", "?q=://org/es/"]
    urls = [f"http://{rnd.choice(hosts)}{rnd.choice(paths)}" for _ in range(300)] + [None, "", "mailto:x", "://org/"]
    pages = [(i % 250 if i % 9 else None, u, "x") for i, u in enumerate(urls)] + [(7, "https://a.example.org/es/1", "x")] * 400
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "a.example.org", ""), ("block", "com", "/"),
             ("allow", "com", "/"), ("block", "org", "/es/1"), ("allow", "example.org", "/es/12"), ("allow", "b.com", "/en")]
    got = url_rules.judge(
        spark.createDataFrame(pages, "page_id long, url string, verdict string"),
        spark.createDataFrame(rules, "verdict string, host string, path string"),
    ).collect()
    want = [(i, *brute_judge(u, rules)) for i, u, _ in pages]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_no_pages_and_no_rules(spark):
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [tuple(r) for r in url_rules.judge(pages, rules).collect()] == [(1, "a.b", "/c", None, "allow")]
    assert url_rules.judge(pages.limit(0), rules).count() == 0


# --- SimHash ---------------------------------------------------------------------


def brute_simhash(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aB é\n\t Ü.", max_size=40))
@settings(max_examples=150, deadline=None)
def test_simhash_equals_brute_force(text):
    assert simhash.fingerprint(text) == brute_simhash(text)


def brute_components(values, bits):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    pairs = [(a, b) for a in parent for b in parent if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits]
    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return pairs, {v: find(v) for v in parent}


@pytest.mark.parametrize("most", [2, 64])
@pytest.mark.parametrize("bits", [1, 2])
def test_pairs_and_components_equal_brute_force(spark, most, bits):
    rnd = random.Random(9)
    values = {0}
    for _ in range(8):
        x = rnd.getrandbits(64)
        for _ in range(12):
            values.add(x)
            x ^= 1 << rnd.randrange(64)  # chains
    close = rnd.getrandbits(48)
    values |= {close | rnd.getrandbits(16) << 48 for _ in range(60)}  # one long list
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    pairs, roots = brute_components(signed, bits)
    found = simhash.near_pairs(df, bits, most)
    assert sorted(map(tuple, found.collect())) == sorted(pairs)
    got = dict(map(tuple, simhash.components(found).collect()))
    assert all(got.get(v, v) == r for v, r in roots.items())


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    own = {r["doc_id"]: r["component_id"] for r in rows}
    assert own[2] == own[3] == 2 and own[1] == 1
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 3 not in ids and None in ids
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_first(no_docs).count() == 0


def test_keep_first_of_repeated_ids(spark):
    a, b = "one two three four five six", "red green blue black white grey"
    rows = [(3, a), (5, a), (5, b), (9, b), (7, b.upper()), (11, "Un deux trois"), (11, "un deux trois"), (11, "un deux trois")]
    rows += [(None, a), (12, None), (12, "")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((i, t or "") for i, t in kept), key=repr) == sorted(
        [(3, a), (5, b), (11, "Un deux trois"), (None, a), (12, "")], key=repr
    )


# --- quality ---------------------------------------------------------------------


def test_forward_backward_equals_enumeration():
    rnd = np.random.default_rng(4)
    counts = np.array([3, 1, 4])
    odds, trans = rnd.normal(size=8), rnd.normal(size=(2, 2))
    good, pairs, logz = quality.forward_backward(odds, trans, counts)
    at, want_pairs = 0, np.zeros((2, 2))
    for d, n in enumerate(counts):
        weights = {}
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            weights[tuple(y)] = math.exp(sum(odds[at + i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        z = sum(weights.values())
        assert math.isclose(math.log(z), logz[d])
        for i in range(n):
            assert math.isclose(sum(w for y, w in weights.items() if y[i]) / z, good[at + i])
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += w / z
        at += n
    assert np.allclose(pairs, want_pairs)


def test_quality_of_odd_rows(spark, odd_docs, no_docs, odd_labels):
    model = quality.fit(odd_docs, odd_labels)
    scores = [r["score"] for r in quality.score_documents(odd_docs, model).collect()]
    assert len(scores) == odd_docs.count() and all(0 <= s <= 1 for s in scores)
    assert quality.keep_good(odd_docs, model).columns == odd_docs.columns
    none = quality.fit(odd_docs, odd_labels.limit(0))
    assert quality.score_documents(odd_docs, none).first()["score"] == 0.5
    assert quality.score_documents(no_docs, model).count() == 0


def test_quality_learns_from_long_documents(spark):
    rows = [(i, "\n".join(("Plain words end here." if i % 2 else "||| 77 !!! ###") for _ in range(500))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int"))
    scores = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, model).collect()}
    assert all((scores[i] > 0.5) == bool(i % 2) for i in scores)


def test_quality_learns_null_texts_as_one_empty_line(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, quality int"))
    assert quality.score_documents(docs, model).first()["score"] < 0.5


def test_run_of_lines_is_part_of_the_whole():
    text = "\n".join(f"line {i} {i * i}" for i in range(50))
    rows, sizes = quality.line_features(text)
    part, own = quality.line_features(text, 20)
    at = [a for a in range(31) if rows[a:a + 20] == part]
    assert at and sizes[at[0]:at[0] + 20] == own
    assert quality.line_features(text, 50) == (rows, sizes)


# --- mixing ----------------------------------------------------------------------


def brute_targets(sizes, budget=1.5, most=2.0, weights=(3.0, 1.0, 2.0)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    words = budget * sum(sizes.values())
    fixed = {s for s in sizes if sizes[s] == 0}
    while True:
        rest = words - sum(most * sizes[s] for s in fixed)
        free = sum(w[s] for s in sizes if s not in fixed)
        over = {s for s in sizes if s not in fixed and rest * w[s] / free > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in fixed else rest * w[s] / free for s in sizes}
        fixed |= over


def test_mix_meets_targets(spark):
    rnd = random.Random(5)
    rows = [(i, "w " * rnd.choice([0, 1, 3, 10, 40, 200]), rnd.choice(["a", "a", "a", "b", "é", "c", None, "z"])) for i in range(900)]
    rows += [(5000, None, "void")] + [rows[0]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    size = Counter()
    for _, text, source in rows:
        size[source] += len((text or "").split())
    want = brute_targets(size)
    taken, expected = Counter(), Counter()
    for r in got:
        assert 0 <= r["copies"] <= 2 and r["source_size"] == size[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        taken[r["source"]] += r["copies"] * r["size"] * r["n"]
        expected[r["source"]] += min(r["rate"], 2.0) * r["size"] * r["n"]
    for s, t in want.items():
        assert abs(expected[s] - t) <= 1e-5 * t + 1e-6
        assert abs(taken[s] - t) <= 0.01 * t + 200
    # rates are exponential in size within a source
    own = {r["size"]: math.log(r["rate"]) for r in got if r["source"] == "a" and 0 < r["size"] and r["rate"] < 2}
    slopes = {round(v / s, 9) for s, v in own.items()}
    assert len(slopes) <= 1
    again = sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    assert again == sorted(map(tuple, got), key=repr)
    copies = mixing.take(docs, spark.createDataFrame(got, mixing.mix(docs).schema))
    assert copies.columns == docs.columns
    assert copies.count() == sum(r["copies"] * r["n"] for r in got)


def test_mix_tells_when_targets_are_missed(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 9 + 1), "ab"[i % 3 == 0]) for i in range(60)], "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(RuntimeError, match="targets"):
        mixing.mix(docs)


def test_mix_of_odd_rows(odd_docs, no_docs):
    assert mixing.mix(no_docs).count() == 0
    mixed = mixing.mix(odd_docs)
    assert sum(r["n"] for r in mixed.collect()) == odd_docs.count()
    assert mixing.take(odd_docs, mixed).columns == odd_docs.columns


# --- licenses --------------------------------------------------------------------


@given(st.lists(st.sampled_from(["mit", "MIT", "license", "license,", "apache", "general public", "x", "é", "MIT-license", " "]), max_size=12))
@settings(max_examples=150, deadline=None)
def test_base_places_equal_brute_force(parts):
    text = " ".join(parts)
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    places = [
        (i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()
    ]
    found = licenses.scan(text)
    assert found["n_words"] == len(words) and found["n_base"] == len(places)
    assert found["first_word"] == min((i for i, _ in places), default=None)
    assert found["last_word"] == max((i for i, _ in places), default=None)
    assert found["base_labels"] == ",".join(sorted({x for _, x in places}))


def test_seeds_lose_no_match():
    rnd = random.Random(8)
    notices = licenses.NOTICES
    hits = 0
    for _ in range(60):
        i = rnd.randrange(len(notices))
        notice = list(notices[i][0])
        for _ in range(rnd.randrange(licenses.edits_for(notices[i][0]) + 3)):
            at = rnd.randrange(len(notice))
            notice[at:at + 1] = rnd.choice([[], [notice[at], "q"], ["z"]])
        text = "some words before " + "".join(notice) + " and after"
        text = " ".join(text.split())
        k = licenses.edits_for(notices[i][0])
        plain = regex.search(rf"(?:{regex.escape(notices[i][0], special_only=True, literal_spaces=True)}){{e<={k}}}", text)
        spans = [s for s in licenses.notice_spans(text) if s[0] == i]
        assert bool(plain) == bool(spans)
        assert all(e <= k for *_, e in spans)
        hits += bool(plain)
    assert hits > 20


def test_scan_of_odd_rows(odd_docs, no_docs):
    rows = licenses.scan_licenses(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["n_base"] == 0 and r["first_word"] is None for r in rows)
    assert licenses.scan_licenses(no_docs).count() == 0


# --- toxicity --------------------------------------------------------------------


def brute_segments(values):
    """Maximal scoring segments by recursion on the best segment; of equal ones the shortest, then leftmost."""

    def solve(lo, hi):
        best = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += values[b]
                if total <= 1e-12:
                    continue
                gain = 1.0 if best is None else total - best[2]
                if gain > 1e-12 or (gain > -1e-12 and b + 1 - a < best[1] - best[0]):
                    best = (a, b + 1, total)
        if best is None:
            return []
        return solve(lo, best[0]) + [best] + solve(best[1], hi)

    return solve(0, len(values))


@given(st.lists(st.sampled_from([-0.25, -0.25, -0.25, 1.0, 2.5, -1.5, 0.375]), max_size=25))
@settings(max_examples=200, deadline=None)
def test_segments_equal_brute_force(values):
    marked = [(i, v) for i, v in enumerate(values) if v != -0.25]
    got = toxicity.maximal_segments(marked, -0.25)
    want = brute_segments(values)
    assert math.isclose(sum(s for *_, s in got), sum(s for *_, s in want), abs_tol=1e-9)
    assert sorted(round(s, 9) for *_, s in got) == sorted(round(s, 9) for *_, s in want)


def test_toxicity_finds_planted_words(spark):
    rnd = random.Random(6)
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        words = rnd.choices(plain, k=60)
        bad = i % 8 == 0
        if bad:
            words[rnd.randrange(60)] = "nasty"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r["doc_id"]: (r["score"], r["passages"]) for r in toxicity.score_documents(docs, model).collect()}
    assert all((found[i][0] >= 0.5) == bool(t) for i, _, t in labels)
    words = rows[8][1].split()
    assert any(p["start_word"] <= words.index("nasty") <= p["end_word"] for p in found[8][1])


def test_toxicity_counts_distinct_documents(spark):
    rnd = random.Random(7)
    rows, labels = [], []
    for i in range(300):
        words = rnd.choices([f"word{j}" for j in range(200)], k=40)
        # "vile" always follows "utterly", which clean texts hold as well; "echo" spreads with copies of one text.
        words[20:22] = ["utterly", "vile"] if i % 3 == 0 else ["utterly", "fine"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 3 == 0)))
    for i in range(300, 500):
        rows.append((i, "echo of one text"))
        labels.append((i, 1, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.score[b"vile"] > 1
    assert b"echo" not in model.score and b"utterly" not in model.score


def test_toxicity_of_odd_rows(odd_docs, no_docs, odd_labels):
    model = toxicity.fit(odd_docs, odd_labels)
    scores = [r["score"] for r in toxicity.score_documents(odd_docs, model).collect()]
    assert len(scores) == odd_docs.count() and all(0 <= s <= 1 for s in scores)
    assert toxicity.keep_clean(odd_docs, model).columns == odd_docs.columns
    none = toxicity.fit(odd_docs, odd_labels.limit(0))
    assert max(r["score"] for r in toxicity.score_documents(odd_docs, none).collect()) < 0.5
    assert toxicity.score_documents(no_docs, model).count() == 0
