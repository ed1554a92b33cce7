"""Filter audits, nearest neighbours and whitening against plain versions of them."""

import collections
import itertools
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnwick.llm import bpe, filter_audit, licenses, neighbours, packing, queries, whitening
from tarnwick.llm.library_tokens import LibraryEncoder

DOCS = "doc_id long, text string, lang string, n int, good int, mask string, salt string"
LABELS = "doc_id long, quality int, toxic int, n int"


def plain_audit(docs, labels):
    """Every order applied to every document."""
    failed = []
    for i, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        twin = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": twin}
        tags = [(q, x) for k, q, x in labels if k == i and k is not None]
        failed.append((part or "", {f for f in fails if fails[f]}, any(q == 1 for q, _ in tags), any(x == 1 for _, x in tags)))
    out, shapley = {}, collections.Counter()
    for part in {p for p, *_ in failed}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in failed if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                fails = [r for r in failed if r[0] == part and f in r[1]]
                out[part, order, step] = [len(kept), len(gone), len(fails) - len(gone), sum(r[1] == {f} for r in fails), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] += len(gone)
                left = kept
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def some_documents(seed, n):
    r = random.Random(seed)
    texts = ["", None, "word " * 4000, " ".join(f"w{k}" for k in range(250)), "A" * 500, "a\x0bb\x1fc\xa0d é漢 #", "$"]
    for _ in range(12):
        texts.append(" ".join(r.choice(["a", "B", "Word", "x|y", "é", f"u{r.randint(0, 400)}"]) for _ in range(r.choice([3, 150, 220, 400]))))
    return [(r.choice([None, *range(40)]), r.choice(texts), r.choice(["en", "fr", None, ""])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_filter_audit(spark, seed):
    docs = some_documents(seed, 150)
    r = random.Random(seed + 9)
    labels = [(r.choice([None, *range(50)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(60)]
    got = filter_audit.audit_documents(spark.createDataFrame([(*d, 1, 2, "m", "s") for d in docs], DOCS), spark.createDataFrame([(*x, 1) for x in labels], LABELS)).collect()
    got = {(r[0], r[1], r[2]): tuple(r)[3:] for r in got}
    assert got == plain_audit(docs, labels)


def test_filter_audit_without_documents(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1, 0, 1)], LABELS)
    assert filter_audit.audit_documents(docs, labels).collect() == []
    one = spark.createDataFrame([(7, "x", None, 1, 1, "m", "s")], DOCS)
    assert len(filter_audit.audit_documents(one, labels.limit(0)).collect()) == 600


def test_filter_audit_sql(spark):
    path = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    got = queries.op11_filter_audit(spark, path)
    want = c.execute(queries.ORACLES["op11_filter_audit"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 1, 2, "x", 0.5) for i, v in rows], f"vec_id long, embedding array<{kind}>, q int, node int, key string, score double")


def plain_nearest(rows, k=20):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in good:
        if i % 20 == 0:
            others = sorted({(-float((np.array(v) * np.array(u)).sum()), j) for j, u in good if j != i and len(u) == len(v)})
            out.setdefault(i, others[:k])
    return out


HARD_VECTORS = [(9001, None), (9002, []), (9003, [0.0] * 8), (9004, [float("nan")] * 8), (9005, [1.0, None] + [0.0] * 6), (9006, [float("inf")] * 8), (None, [1.0] * 8), (9020, [1.0, 2.0]), (9021, [3.0, -1.0]), (9040, [2.0])]


def test_nearest_is_exact_with_all_leaves(spark):
    """Small whole numbers: many equal scores and vectors, and repeated rows."""
    r = random.Random(3)
    rows = [(i, [float(r.randint(-1, 1)) for _ in range(8)]) for i in range(600)]
    rows += [(i, [1.0] * 8) for i in range(600, 900)] + rows[:40] + HARD_VECTORS
    got = collections.defaultdict(list)
    for x in neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, leaf=40, recall=1.0, measured=600, block=16).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((-x["score"], x["vec_id"]))
        assert x["rank"] == len(got[x["query_id"]])
    want = plain_nearest(rows)
    assert {q: [s for s, _ in w] for q, w in want.items() if w}.keys() == got.keys()
    hit = sum(len({*got[q]} & {*w}) for q, w in want.items())
    assert hit >= 0.98 * sum(map(len, want.values()))
    assert all(len(got[q]) == len(w) for q, w in want.items())


@pytest.mark.parametrize("kind,clusters", [("float", 40), ("double", 0)])
def test_nearest_recall(spark, kind, clusters):
    """Of clustered vectors, few leaves are taken; of vectors without structure, as many as it needs."""
    g = np.random.default_rng(5)
    v = g.normal(size=(4000, 24)) if not clusters else g.normal(size=(clusters, 24))[np.arange(4000) % clusters] + 0.2 * g.normal(size=(4000, 24))
    v = v.astype(np.float32).astype(float) * g.uniform(0.5, 1.5, (4000, 1)).astype(np.float32)
    v = v.astype(np.float32).astype(float)
    out = neighbours.nearest(vectors(spark, [(i, x.tolist()) for i, x in enumerate(v)], kind), F.col("vec_id") % 20 == 0, leaf=64).collect()
    hit = 0
    of = collections.defaultdict(list)
    for x in out:
        of[x["query_id"]].append(x)
    assert sorted(of) == list(range(0, 4000, 20))
    for q, found in of.items():
        s = (v * v[q]).sum(1)
        s[q] = -np.inf
        hit += len({x["vec_id"] for x in found} & {*np.argsort(-s)[:20].tolist()})
        found.sort(key=lambda x: x["rank"])
        assert len(found) == 20 and all(x["score"] == s[x["vec_id"]] for x in found)
        assert [(-x["score"], x["vec_id"]) for x in found] == sorted((-x["score"], x["vec_id"]) for x in found)
    assert hit >= 0.9 * 20 * len(of)


def test_budget_follows_structure():
    g = np.random.default_rng(6)
    centres = g.normal(size=(64, 16))
    x = centres[np.arange(8192) % 64] + 0.05 * g.normal(size=(8192, 16))
    norm = float(np.sqrt((x * x).sum(1).max()))
    forest = neighbours.grow(x[:2048], norm, 4, 7)
    sizes = np.bincount(forest.slots(x).ravel(), minlength=4 * forest.leaves)
    assert [sizes[t * 128 : (t + 1) * 128].sum() for t in range(4)] == [8192] * 4
    order = forest.queue(x[:50])
    assert (np.sort(order, 1) == np.arange(512)).all()  # one queue for all trees
    assert len({*(order[:, :8] // 128).ravel().tolist()}) == 4
    at, slot = neighbours.taken(forest, x[:50], sizes, 3, 21)
    for q in range(50):
        mine = slot[at == q]
        assert len(mine) >= 3 and max(sizes[mine[mine // 128 == t]].sum() for t in range(4)) >= 21


def test_nearest_without_vectors(spark):
    for rows in ([], HARD_VECTORS[:7], [(1, [1.0])], [(20, [1.0, 2.0])]):
        assert neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect() == []
    few = neighbours.nearest(vectors(spark, [(20, [1.0, 2.0]), (21, [1.0, 2.0]), (3, [-1.0, 0.0])]), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, few)) == [(20, 1, 21, 5.0), (20, 2, 3, -1.0)]


def exact_whitening(rows):
    x = np.array([[int(1024 * Fraction(c) // 1) + 100000 for c in v] for _, v in rows], object)
    n, total = len(x), x.sum(0)
    centred = np.array([[float(Fraction(int(n * a - s), n)) for a, s in zip(r, total)] for r in x])
    v = np.array([[float(Fraction(int(c), n * n)) for c in r] for r in n * x.T.dot(x) - np.outer(total, total)])
    e, u = np.linalg.eigh(v)
    return [int(sum((n * a - s) ** 2 for a, s in zip(r, total))) for r in x], centred @ u[:, ::-1], e[::-1]


@pytest.mark.parametrize("kind,scale", [("float", 1.0), ("double", 1e7), ("double", 1e17), ("double", 1e-4)])
def test_whitening(spark, kind, scale):
    g = np.random.default_rng(7)
    v = (g.normal(size=(300, 10)) * np.arange(1, 11) * scale).astype(np.float32).astype(float)
    v = np.vstack([v, v[:30]])
    rows = [(i if i % 50 else None, x.tolist()) for i, x in enumerate(v)]
    out = whitening.whiten(vectors(spark, [*rows, (1, None), (2, [float("nan")] * 10), (3, [None] * 10), (4, [1.0]), (5, [])], kind)).collect()
    deviation, projected, e = exact_whitening(rows)
    assert len(out) == 8 * len(rows) and {r["n"] for r in out} == {330}
    assert collections.Counter((r["vec_id"], r["deviation"]) for r in out if r["component"] == 1) == collections.Counter((i, d if d < 10**38 else None) for (i, _), d in zip(rows, deviation))
    by_id = {i: k for k, (i, _) in enumerate(rows) if i is not None}
    for c in range(8):
        if e[c] <= e.sum() * 1e-13:
            continue
        mine = [(by_id[r["vec_id"]], r["whitened"], r["explained"]) for r in out if r["component"] == c + 1 and r["vec_id"] is not None]
        got, want = np.array([w for _, w, _ in mine]), projected[[k for k, _, _ in mine], c] / np.sqrt(e[c])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
        assert abs(mine[0][2] - e[c] / e.sum()) < 1e-12
    assert {r["identity_error"] for r in out if r["identity_error"] is None or r["identity_error"] > 1e-9} == set()


def test_scatter_is_exact():
    r = random.Random(8)
    for top in (3, 1 << 20, 1 << 60, 1 << 400):
        y = [[r.randint(-top, top) for _ in range(5)] for _ in range(200)]
        block = np.array(y, np.int64 if top < 1 << 62 else object)
        assert (whitening.scatter(block) == np.array(y, object).T.dot(np.array(y, object))).all()
    for value in (0, 5, -5, 1 << 32, -(1 << 100) - 7):
        assert sum(x << (whitening.LIMB * p) for p, x in whitening.limbs_of(value)) == value


def test_whitening_of_hard_tables(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, HARD_VECTORS[:2])).collect() == []
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert len(same) == 6 and all(r["deviation"] == 0 and r["whitened"] is None and r["identity_error"] is None and r["explained"] == 0 for r in same)
    huge = whitening.whiten(vectors(spark, [(1, [1e300, 2.0]), (2, [-1e300, 5.0]), (3, [1e18, 2.5])])).collect()
    assert len(huge) == 6 and all(r["deviation"] is None for r in huge) and {r["whitened"] is None for r in huge} == {True, False}



def long_stretches():
    """Texts without spaces: permuted kilobytes (of letters, of CJK signs, of base64), and many that are new to a worker."""
    r = random.Random(21)
    texts = []
    for signs, size in (("abcdefgh", 1024), ("\u4e00\u4e8c\u4e09\u56db\u4e94\u65e5\u6708", 342), ("ABCDabcd0123+/", 1024)):
        x, y, z = ("".join(r.choice(signs) for _ in range(size)) for _ in range(3))
        texts += [a + b + c + d for a, b, c, d in ((x, y, y, x), (y, x, x, y))] + [x + z + y, y + z + x, (x + y) * 8 + (y + x) * 8, (y + x) * 8 + (x + y) * 8]
        texts += [f"{x} {y} and {x}{y}", f" {y}", f"{y} ", f"  {x}  {y}"]
    return texts


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_long_stretches_of_library_tokens(name, spaces):
    mine, whole, texts = LibraryEncoder(P.path(name), spaces, bound=100), Tokenizer.from_file(P.path(name)), long_stretches()
    want = [[*whole.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    for columns in ([pa.array([t]) for t in texts], [pa.array(texts)], [pa.array(texts[::-1])[::-1]]):
        got = [part.tolist() for c in columns for _, ids, n in mine.ended(c, 7) for part in np.split(ids, np.cumsum(n)[:-1])]
        assert got == want


def test_long_stretches_of_byte_bpe():
    codec, texts = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), long_stretches()
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.rank, special_tokens={})
    want = [plain.encode_ordinary(t) for t in texts]
    for columns in ([pa.array([t]) for t in texts], [pa.array(texts)]):
        got = [part.tolist() for c in columns for _, ids, n in codec.encode_many(c) for part in np.split(ids, np.cumsum(n)[:-1])]
        assert got == want


def test_store_of_stretches_is_bounded():
    """In entries and in ids, whatever the texts; and every text has its ids."""
    mine, r = LibraryEncoder(P.path("byte_bpe_50k.json"), True, bound=2_000), random.Random(22)
    for _ in range(40):
        texts = ["".join(r.choice("abcxyz\u4e00\u4e8c") for _ in range(r.choice([3, 90, 2000]))) for _ in range(60)]
        assert sum(len(n) for _, _, n in mine.ended(pa.array(texts), 7)) == 60
        texts = [" ".join("".join(r.choice("abcxyz\u4e00\u4e8c") for _ in range(60)) for _ in range(20)) for _ in range(20)]
        assert sum(len(n) for _, _, n in mine.ended(pa.array(texts), 7)) == 20
        for store in (mine.stretches.units, mine.stretches.pieces):
            assert store.n <= store.bound + 2_000 and store.used_ids <= store.ids_bound + 120_000


PASSAGE_LABELS = [label for label, _ in licenses.PASSAGES]


def documents_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_each_license_passage_has_its_label(spark):
    """Each passage alone, with words put in, and each after each other one: sister licenses don't answer for each other."""
    r, texts, want = random.Random(23), [], []
    for label, passage in licenses.PASSAGES:
        w = passage.split()
        k = len(w) // 2
        for text in (passage, " ".join([*w[:k], "so", "to", "say", *w[k:]]), " ".join(["some", "words", *w, "more", "words"])):
            texts.append(text)
            want.append({label})
    for a, one in licenses.PASSAGES:
        for b, two in licenses.PASSAGES:
            texts.append(f"{one} {' '.join(r.choice(['lorem', 'ipsum', 'dolor']) for _ in range(r.randint(0, 12)))} {two}")
            want.append({a, b})
    got = {x["doc_id"]: {*x["labels"].split(",")} for x in licenses.scan(documents_of(spark, texts)).collect()}
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != want[i]] == []


def test_license_passage_with_a_bracket(spark):
    text = "This work is licensed under a Creative Commons Attribution 4.0 International License (CC BY 4.0 International License)"
    one = licenses.scan(documents_of(spark, [text])).first()
    assert (one["labels"], one["score"]) == ("cc-by", 1.0)


def fewest_bins(sizes, capacity):
    """By a search over all ways, for few sizes."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def put(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for room in sorted({x for x in rooms if x >= sizes[k]}):
            rest = [*rooms]
            rest[rest.index(room)] -= sizes[k]
            put(k + 1, rest)
        put(k + 1, [*rooms, capacity - sizes[k]])

    put(0, [])
    return best[0]


def test_bin_completion_is_exact():
    example = [8, 11, 13, 14, 14, 15, 23, 24, 27, 30]
    assert sum(n for _, n in packing.complete_bins(collections.Counter(example), 60, 100_000)) == 3
    r = random.Random(24)
    for _ in range(1000):
        capacity = r.choice([20, 60, 100])
        sizes = [r.randint(1, capacity * r.choice([2, 3, 5]) // 5) for _ in range(r.randint(1, 12 if r.random() < 0.7 else 20))]
        plan = packing.complete_bins(collections.Counter(sizes), capacity, 100_000)
        assert collections.Counter(s for f, n in plan for s in f * n) == collections.Counter(sizes) and all(sum(f) <= capacity for f, _ in plan)
        bins = sum(n for _, n in plan)
        if len(sizes) <= 12 or bins > packing.lower_bound(collections.Counter(sizes), capacity):
            assert bins == fewest_bins(sizes, capacity)


def test_undominated_fillings():
    r = random.Random(25)
    for _ in range(300):
        room, counts = r.randint(1, 40), collections.Counter(r.randint(1, 25) for _ in range(r.randint(0, 8)))
        items = sorted(counts.elements())
        every = {tuple(sorted(c, reverse=True)) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room}

        def beaten(f):
            """A length that is left takes the place of a shorter one, or of none."""
            left = collections.Counter(items) - collections.Counter(f)
            return any(s < x <= s + room - sum(f) for s in {0, *f} for x in left)

        got = [f for f in packing.fillings(room, dict(counts)) if f is not None]
        assert len(got) == len({*got}) and {*got} == {f for f in every if not beaten(f)}
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)
