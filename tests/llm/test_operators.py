"""The training-data operators against brute force, on small tables with nulls, ties, copies and clashing columns."""

import collections
import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnwick.llm import bpe, context_trees, edit_embedding, licenses, packing, range_join, secrets, simhash, token_files, toxicity
from tarnwick.llm.common import shared_path
from tarnwick.llm.components import components
from tarnwick.llm.library_tokens import LibraryEncoder

ALPHABET = "aB c d'sret  \n\t \x1c\xa0é漢1 2!!'llÉΣ<|endoftext|>́😀İK.,."
RANKS = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, part int, ids string, fp long, h long, t string, n int"


def some_texts(seed, n, length=40, alphabet=ALPHABET):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, length))) for _ in range(n)]


def table(spark, texts, ids=None):
    """With columns whose names the operators use themselves."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, "t", 4) for i, t in zip(ids, texts)], SCHEMA)


HARD = ["", None, "a", " ", "password: abcdefghijklmnop", "same text here", "same text here", "word " * 4000, "é" * 300]


def nodes(edges, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@functools.lru_cache(1)
def codec():
    return bpe.codec(RANKS, P.PATTERN)


@functools.lru_cache(1)
def reference_encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec().rank, special_tokens={})


def test_bpe_equals_tiktoken():
    for t in some_texts(1, 1500) + [x or "" for x in HARD]:
        ids = codec().encode(t)
        assert memoryview(ids).cast("I").tolist() == reference_encoding().encode_ordinary(t)
        assert codec().decode(ids) == t.encode()


def test_bpe_edits_are_exact_and_local():
    r = random.Random(2)
    for t in some_texts(3, 300, 60):
        e = bpe.Editable(codec(), t)
        for x in some_texts(r.random(), 3, 6):
            a = r.randint(0, len(e.text))
            b = r.choice([a, min(len(e.text), a + 4)])
            want = e.text[:a] + x + e.text[b:]
            e.replace(a, b, x)
            assert (e.text, e.ids) == (want, reference_encoding().encode_ordinary(want))
    long = bpe.Editable(codec(), "some words here " * 500)
    assert long.replace(4000, 4002, "zz") < 12
    assert long.prefix_ids(0, 2) == reference_encoding().encode_ordinary("so")


def test_bpe_table(spark):
    rows = {r["doc_id"]: r for r in bpe.digest_documents(table(spark, HARD), RANKS, P.PATTERN).collect()}
    for i, t in enumerate(HARD):
        ids = reference_encoding().encode_ordinary(t or "")
        assert rows[i]["n_tokens"] == len(ids) and rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digest_documents(table(spark, HARD).limit(0), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_library_encoder(name, spaces):
    mine, whole = LibraryEncoder(P.path(name), spaces, bound=200), Tokenizer.from_file(P.path(name))
    texts = some_texts(4, 1500) + HARD + ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|startoftext|>  y", "<|end oftext|>"]
    texts += [" ".join(some_texts(5, 40)), "x" * 2000 + " y", "  ", "a  b", "a \t b", "\u2028 a\u3000 b\r\n c"]
    for t in texts:
        assert memoryview(mine.encode(t or "")).cast("I").tolist() == whole.encode(t or "", add_special_tokens=False).ids
    for column in (pa.array(texts), pa.array([None, *texts], pa.string())[1:]):  # many at a time, and from a slice
        got = [part for _, ids, n in mine.ended(column, 7) for part in np.split(ids, np.cumsum(n)[:-1])]
        assert [g.tolist() for g in got] == [[*whole.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]


def test_license_phrases(spark):
    r = random.Random(5)
    words = "under the mit license apache version 2 cc by nc MIT License é x".split()
    texts = ["".join(r.choice(words) + r.choice([" ", "-", "\n", ", "]) for _ in range(r.randint(0, 25))) for _ in range(150)]
    texts += HARD + ["under the mıt license", "Under The MIT LICENSE", "K cc by nc", "!cc by nc!", "cc by nc cc by nc"]
    got = {r["doc_id"]: r for r in licenses.scan(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        hits = sorted((k, label) for label, p in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(w), len(hits))
        assert (got[i]["first_word"], got[i]["last_word"]) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert got[i]["base_labels"] == ",".join(sorted({x for _, x in hits})) and {*filter(None, got[i]["base_labels"].split(","))} <= {*got[i]["labels"].split(",")}


def test_license_passages(spark):
    w = licenses.PASSAGES[0][1].split()
    edited = " ".join(w[:20] + ["inserted", "words"] + w[20:])
    scattered = " ".join(f"{a} zz" for a in w)
    got = {r["doc_id"]: r for r in licenses.scan(table(spark, [edited, scattered, " ".join(w[:12])])).collect()}
    assert got[0]["labels"] == "mit" and got[0]["base_labels"] == "" and got[0]["score"] > 0.9
    assert got[1]["labels"] == got[2]["labels"] == ""
    twice = licenses.scan(table(spark, ["cc by nc"] * 2, [7, 7])).collect()
    assert [r["n_base"] for r in twice] == [1, 1]


def test_token_files(spark):
    texts, path = some_texts(6, 60) + HARD + ["an <|endoftext|> here", "<|endoftext|>"], shared_path(spark, "test-tokens")
    ids = random.Random(7).sample(range(1000), len(texts))
    token_files.write_tokens(table(spark, texts, ids), path, P.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in token_files.with_checksums(token_files.read_tokens(spark, path, "n_tokens", "ids")).collect()}
    whole, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    for i, t in sorted(zip(ids, texts)):
        want = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[i]["n_tokens"] == len(want) and got[i]["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        assert got[i]["start"] == start
        start += got[i]["n_tokens"]


@functools.lru_cache(None)
def fewest_bins(items, capacity):
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_bin_completion():
    r = random.Random(8)
    for _ in range(150):
        items = tuple(sorted((r.randint(1, 30) for _ in range(r.randint(1, 9))), reverse=True))
        plan = packing.complete_bins(collections.Counter(items), 30)
        assert sum(n for _, n in plan) == fewest_bins(items, 30) >= packing.lower_bound(collections.Counter(items), 30)
        assert sorted(x for f, n in plan for x in f * n) == sorted(items) and all(sum(f) <= 30 for f, _ in plan)


def test_packing_table(spark):
    texts = [t for t in some_texts(9, 80, 300, "abcd efgh ")] + HARD
    tokenizer = P.path("word_bpe_49k.json")
    rows = packing.pack_documents(table(spark, texts), tokenizer, 64).collect()
    whole, bins, pieces = Tokenizer.from_file(tokenizer), collections.defaultdict(list), collections.defaultdict(dict)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]][r["piece"]] = r
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        assert sorted(pieces[i]) == list(range(-(-len(ids) // 64)))
        for k, r in pieces[i].items():
            part = ids[64 * k : 64 * k + 64]
            assert (r["start"], r["length"], r["ids_crc32"]) == (64 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) == packing.lower_bound(collections.Counter(r["length"] for r in rows), 64)


@pytest.mark.parametrize("head", [1 << 20, 3])
def test_context_trees(spark, head):
    texts, depth = ["abab", "abba b", "", None, "baAb", "é", "abab"], 2
    got = {r["doc_id"]: r for r in context_trees.score(table(spark, texts), F.col("doc_id") != 4, depth, head, 2).collect()}
    low = [(t or "").encode().lower() for t in texts]
    count = collections.defaultdict(lambda: [0, 0])

    def steps(x):
        z = b"\xff" * depth + x + b"\xff"
        return [(z[k - depth : k], (1 << i) | (z[k] >> (8 - i)), (z[k] >> (7 - i)) & 1) for k in range(depth, len(z)) for i in range(8)]

    for i, x in enumerate(low):
        for context, node, bit in steps(x) if i != 4 else ():
            for d in range(depth + 1):
                count[context[depth - d :], node][bit] += 1
    contexts = {c[k:] for x in low for c, _, _ in steps(x) for k in range(depth + 1)}
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @functools.lru_cache(None)
    def weighted(context, node):
        own = kt(*count[context, node])
        if len(context) == depth:
            return own
        return np.logaddexp(own, sum(weighted(c, node) for c in contexts if len(c) == len(context) + 1 and c.endswith(context))) - math.log(2)

    def one(context, node, d=0):
        n0, n1 = count[context[depth - d :], node]
        p = (n1 + 0.5) / (n0 + n1 + 1)
        if d == depth:
            return p
        share = math.exp(kt(n0, n1) - weighted(context[depth - d :], node) - math.log(2))
        return share * p + (1 - share) * one(context, node, d + 1)

    words = collections.Counter(w for i, x in enumerate(low) if i != 4 for w in [*x.split(), b"\n"])
    n, v = sum(words.values()), len(words)
    for i, x in enumerate(low):
        want = sum(math.log10(one(c, k) if b else 1 - one(c, k)) for c, k, b in steps(x))
        tokens = [*x.split(), b"\n"]
        assert got[i]["score"] == pytest.approx(want)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((words[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"], got[i]["held_out"]) == (len(tokens), sum(words[t] > 0 for t in tokens), n, i == 4)


SECRET_PATTERNS = (
    (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 12),
    (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
)


def test_secret_spans(spark):
    r, parts = random.Random(10), ["password", "PassWd", "secret", "token", "apikey", "api_key", "=", " ", ":", "'", '"', "abcdef0123456789", "AKIA", "AKIAABCDEF123456ZZ", "é", "漢", "x", "==", "\n", "ghp_"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    scan = secrets.scanner().spans
    for t in texts:
        want = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(SECRET_PATTERNS) for m in re.finditer(p, t) if ok(m))
        assert [s for s in scan(t.encode()) if s[1] < 3] == want
    rows = {r["doc_id"]: r for r in secrets.report(table(spark, HARD)).collect()}
    assert rows[4]["spans"] == "assign:0:26" and rows[4]["n_assign"] == 1 and rows[1]["spans"] == ""
    kept = {r["doc_id"]: r["text"] for r in secrets.redact(table(spark, HARD)).collect()}
    assert kept == dict(enumerate(HARD)) | {4: "[assign]"}


def test_whole_private_keys(spark):
    r = random.Random(15)
    line = lambda n: "".join(r.choice("ABCxyz019+/") for _ in range(n))
    body = [line(64), line(64), line(21) + "=="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    heads = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF", ""]
    pgp = ["-----BEGIN PGP PRIVATE KEY BLOCK-----", "Version: GnuPG v2", "", *body, "=aB3d", "-----END PGP PRIVATE KEY BLOCK-----"]
    keys = [eol.join(x) for eol in ("\n", "\r\n", "\\n", "\n    ", "\n> ", " ") for x in ([begin, *body, end], [begin, *heads, *body, end], pgp)]
    # Without an END line, or with one that is cut.
    keys += [eol.join(x) for eol in ("\n", "\r\n", "\\n") for x in ([begin, *body], [begin, *heads, *body], [begin, *body[:1]])]
    texts = [f"é before {k}{after}" for k in keys for after in ("", "\n\nAnd a line, after.")]
    want = [f"é before [private_key]{after}" for _ in keys for after in ("", "\n\nAnd a line, after.")]
    texts += [f"{begin} is how it starts.", f"{keys[0]} and {keys[0]}.", f"{begin}\n{body[0]}\n\nText. {keys[0]}!"]
    want += ["[private_key] is how it starts.", "[private_key] and [private_key].", "[private_key]\n\nText. [private_key]!"]
    got = {x["doc_id"]: x["text"] for x in secrets.redact(table(spark, texts)).collect()}
    assert got == dict(enumerate(want))
    k = keys[0]
    assert secrets.scanner().spans(f"é {k} .".encode())[0] == (2, 3, 2 + len(k))


def test_range_join(spark):
    g = np.random.default_rng(1)
    c = g.normal(size=(6, 8))
    v = np.array([c[k % 6] + g.normal(size=8) * 0.25 * (k % 3) for k in range(200)])
    rows = [(int(k * 3), [float(z) for z in x], 1) for k, x in enumerate(v)]
    rows += [(901, None, 1), (902, [0.0] * 8, 1), (903, [float("nan")] * 8, 1), (904, [1.0, None] + [0.0] * 6, 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (None, [1.0, 2.0], 1), (907, [], 1)]
    got = {r["vec_id"]: r for r in range_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int"), cell=20).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    group = nodes(np.argwhere(linked), len(v))
    for i in range(len(v)):
        assert (got[3 * i]["n_links"], got[3 * i]["component_id"], got[3 * i]["kept"]) == (linked[i].sum() - 1, 3 * group[i], group[i] == i)
    assert [(got[k]["n_links"], got[k]["component_id"]) for k in (901, 902, 903, 904, 905, 906, None, 907)] == [(0, 901), (0, 902), (0, 903), (0, 904), (2, 905), (2, 905), (2, 905), (0, 907)]


def test_range_join_by_blocks(spark):
    """Pairs that are each other's only link, in one cell of several blocks."""
    g = np.random.default_rng(2)
    v = np.repeat(g.normal(size=(60, 32)), 2, axis=0) + g.normal(size=(120, 32)) * 0.01
    rows = spark.createDataFrame([(k, [float(z) for z in x]) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    group = nodes(np.argwhere(linked), len(v))
    assert len(set(group)) == 60
    got = {r["vec_id"]: r for r in range_join.near_duplicates(rows, cell=1000, block=16).collect()}
    assert [(got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in range(120)] == [(1, group[i], group[i] == i) for i in range(120)]


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_sliced_links():
    r = random.Random(11)
    for _ in range(40):
        sizes = np.array([r.randint(1, 150 if r.random() < 0.2 else 6) for _ in range(r.randint(1, 8))])
        base = [r.getrandbits(64) for _ in range(4)]
        fps = np.array([r.choice(base) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(sizes.sum())], np.uint64)
        want = [(i, j) for a, n in zip(np.cumsum(sizes) - sizes, sizes) for i in range(a, a + n) for j in range(i + 1, a + n) if int(fps[i] ^ fps[j]).bit_count() <= 4]
        got = list(simhash.sliced_links(fps, sizes, 4))
        assert set(got) <= set(want) and nodes(got, len(fps)) == nodes(want, len(fps)) and len(got) < len(fps)


@pytest.mark.parametrize("chunk", [1024, 3])
def test_simhash(spark, chunk, monkeypatch):
    r = random.Random(12)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash.linked, "__defaults__", (4, chunk))
    base = [[r.choice("abcdefgh") * 3 for _ in range(60)] for _ in range(4)]
    texts = [" ".join(w if r.random() > 0.02 else "zz" for w in r.choice(base)) for _ in range(120)] + HARD
    got = {x["doc_id"]: x for x in simhash.near_duplicates(table(spark, texts)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    group = nodes([(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4], len(fps))
    assert [(got[i]["fingerprint"], got[i]["component_id"]) for i in range(len(fps))] == [(f"{f:016x}", g) for f, g in zip(fps, group)]
    kept = simhash.one_of_each(table(spark, texts))
    assert kept.columns == table(spark, texts).columns and {x["doc_id"] for x in kept.collect()} == {i for i, g in enumerate(group) if i == g}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 400), (400, 401), (7, 7), (900, 901)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {400: 400, 401: 400, 500: 400, 900: 900, 901: 900}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edit_fingerprints(spark):
    texts = some_texts(13, 60, 400) + HARD
    ids = random.Random(14).sample(range(1000), len(texts))
    got = {r["doc_id"]: r for r in edit_embedding.compare_with_edits(table(spark, texts, ids)).collect()}
    rows = sorted((i, t or "") for i, t in zip(ids, texts))
    assert len(got) == len(rows)
    for (i, t), (j, after) in zip(rows, rows[1:] + rows[:1]):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i]["fingerprint"] == edit_embedding.fingerprints([t])[0] and got[i]["edited_fingerprint"] == edit_embedding.fingerprints([edited])[0]
        assert got[i]["near_next"] == edit_embedding.likeness(got[i]["fingerprint"], got[j]["fingerprint"])
    t = " ".join(some_texts(15, 40, 12, "abcdefghij"))
    near, far = (edit_embedding.likeness(*edit_embedding.fingerprints([t, x])) for x in (t[:100] + t[103:], t[::-1]))
    assert near > 0.7 > 0.4 > far
    pairs = edit_embedding.near_pairs(table(spark, [t, t[:150] + "q" + t[150:], "unlike it in every way " * 9])).collect()
    assert {(p["a"], p["b"]) for p in pairs} == {(0, 1)}


def test_near_pairs_lose_no_link(spark):
    r = random.Random(29)
    bases = ["".join(r.choice("abcdefgh ") for _ in range(200)) for _ in range(3)]
    texts = [t[:k] + "#" * r.randint(0, 3) + t[k:] for t in bases for k in (r.randint(0, 199) for _ in range(8))] + [None, "", bases[0], bases[0]]
    prints = edit_embedding.fingerprints([t or "" for t in texts])
    share = lambda x, y: any(x[k : k + 8] == y[k : k + 8] and len(x[k : k + 8]) == 8 for k in range(0, len(x), 8))
    least = {p: prints.index(p) for p in prints if p}
    want = [(least[x], least[y]) for x, y in itertools.combinations(least, 2) if share(x, y) and edit_embedding.likeness(x, y) >= 0.8]

    def groups(pairs):
        of = {i: {i} for i in range(len(texts))}
        for a, b in pairs:
            both = of[a] | of[b]
            for i in both:
                of[i] = both
        return {frozenset(g) for g in of.values()}

    got = edit_embedding.near_pairs(table(spark, texts), chunk=3).collect()
    assert groups((p["a"], p["b"]) for p in got) == groups(want) and len(want) > 5
    assert {(p["a"], p["b"]) for p in got} <= {tuple(sorted(w)) for w in want}
    assert all(abs(p["likeness"] - edit_embedding.likeness(prints[p["a"]], prints[p["b"]])) < 1e-9 for p in got)


def test_toxicity(spark):
    r, words, bad = random.Random(16), ["alpha", "beta", "gamma", "delta", "eta", "theta"], ["vequa", "vequi", "trash"]
    texts, labels = [], []
    for i in range(400):
        toxic, low = i % 6 == 0, i % 5 == 0
        w = [r.choice(words) for _ in range(30)] + [r.choice(bad)] * (2 * toxic) + ["***"] * (3 * low)
        r.shuffle(w)
        texts.append(" ".join(w))
        labels.append((i, 1 - low, int(toxic)))
    docs = table(spark, texts + ["nothing vequon here", "nothing here", None, ""], [*range(400), 1000, 1001, 1002, 1003])
    marks = spark.createDataFrame(labels[:300] + [(None, 1, 1), (0, None, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.learn_from_labels(docs, marks)
    got = {x["doc_id"]: x for x in toxicity.score(docs, chain).collect()}
    assert all(got[i]["toxic"] == bool(t) and (got[i]["p_low_quality"] > 0.5) == (not q) for i, q, t in labels[300:])
    assert got[1000]["toxic"] and not any(got[i]["toxic"] for i in (1001, 1002, 1003))
    kept = {x["doc_id"] for x in toxicity.without_toxic(docs, chain).collect()}
    assert kept == {i for i in got if not got[i]["toxic"]}
    nothing = toxicity.learn_from_labels(docs, marks.limit(0))
    assert toxicity.score(docs, nothing).where("toxic or p_toxic > 0").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    from tarnwick.llm import queries

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "secrets", "packing"] and len(queries.QUERIES) == 13
    docs, d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "/root/testdata/sf0.001"
    names = docs.columns
    toxic = {r["doc_id"] for r in queries.op10_toxicity(spark, d).where("toxic").collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in toxic}
    ids = sorted(rows)
    fps = [plain_fingerprint(rows[i]) for i in ids]
    group = nodes([(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4], len(ids))
    want = {i for k, i in enumerate(ids) if group[k] == k}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).select("doc_id").distinct().collect()} == want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == names
    scan = secrets.scanner().spans
    assert not [r for r in docs.collect() if scan(r["text"].encode())]


def test_one_of_each_keeps_rows_apart(spark):
    a, b, c = "one two three four five six", "other words that have nothing in common here", "a third text which is again something else"
    rows = [(1, a), (2, a), (2, b), (5, c), (5, c), (None, a), (None, a), (7, ""), (8, None)]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, fp string, at int")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, a), (2, b), (5, c), (None, a), (None, a), (7, "")], key=str)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_toxicity_is_the_same_over_tasks(spark):
    r = random.Random(31)
    long = "w" * 40
    texts = [" ".join([r.choice(["plain", "good", "word", "text"]) for _ in range(6)] + ([long + "bad", "awful"] if i % 4 == 0 else [long + "fine"])) for i in range(120)]
    docs, labels = table(spark, texts), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    chains = [toxicity.learn(docs, labels, {"toxic": F.expr("toxic = 1")}, least=8, tasks=n) for n in (1, 8, 32)]
    assert "=" + long + "bad" in chains[0].vocabulary and "=" + long + "fine" in chains[0].vocabulary
    for chain in chains[1:]:
        assert chain.vocabulary == chains[0].vocabulary
        for (b1, w1, e1), (b2, w2, e2) in zip(chain.models, chains[0].models, strict=True):
            assert b1 == b2 and (w1 == w2).all() and (e1 == e2).all()


def test_range_join_bounds_both_sides(spark, monkeypatch):
    """Where no pivot excludes anything, what comes to a cell from outside is dealt by blocks too."""
    g = np.random.default_rng(5)
    rows = spark.createDataFrame([(k, [float(z) for z in x]) for k, x in enumerate(g.normal(size=(1500, 6)))], "vec_id long, embedding array<double>")
    kind, dealt = type(rows), []
    whole = kind.mapInArrow

    def noted(self, f, schema, *rest, **more):
        out = whole(self, f, schema, *rest, **more)
        dealt.extend([out] if "side" in out.columns else [])
        return out

    monkeypatch.setattr(kind, "mapInArrow", noted)
    assert range_join.near_duplicates(rows, cell=150, block=150).count() == 1500
    assert dealt[0].groupBy("cell", "i", "j", "side").count().agg({"count": "max"}).first()[0] < 300
    assert [range_join.block_of(n, 64, 12) for n in (100, 100_000, 10**7)] == [4096, 14285, 32768]
