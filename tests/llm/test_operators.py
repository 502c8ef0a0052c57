"""Each operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and brute force where SQL is not used."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, components, jaccard, lines, mixing, neighbours, pseudo_lm, quality, substrings, topk, toxicity
from tidemark.llm.common import Scratch, Words
from tidemark.llm.queries import tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, name string, size long, gone string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "r", "n", 7, "g") for i, t, s in rows], DOC)


def sentence(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


BASE = sentence(1, 60)
ROWS = [(1, BASE, "a"), (2, BASE, "a"), (3, BASE + " extra", "b"), (4, None, "b"), (5, "", None), (6, sentence(2, 3000), "b"), (7, "one two", None), (7, "one two", None), (None, BASE, "a"), (8, " \n\t ", "c"), (9, sentence(3, 30) + " " + BASE, "c")]


@pytest.fixture(scope="module")
def table(spark):
    return docs(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def words(t):
    return (t or "").encode().split()


def test_lines_by_brute_force(spark, empty):
    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
            p = q
        return p[-1]

    r, pool = random.Random(5), [sentence(k, 6) for k in range(12)]
    def vary(x):
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(x))
            x = r.choice([x[:i] + x[i + 1 :], x[:i] + "z" + x[i:], x[:i] + "y" + x[i + 1 :]])
        return x

    texts = [(i, "\n".join(vary(r.choice(pool)) for _ in range(r.randint(1, 6))) + "\n\nshort", "s") for i in range(25)] + [(30, None, "s"), (31, "", "s")]
    first = {}
    for i, t, _ in texts:
        for x in (t or "").split("\n"):
            if x.strip():
                first.setdefault(x, i)
    shadowed = {b for b in first for a in first if a != b and min(len(a), len(b)) >= lines.SHORT and (first[a], a) < (first[b], b) and distance(a, b) <= 2}
    want = {}
    for i, t, _ in texts:
        seen, kept = set(), []
        for x in (t.split("\n") if t is not None else []):
            if x.strip():
                if x in seen or first[x] < i or x in shadowed:
                    continue
                seen.add(x)
            kept.append(x)
        want[i] = None if t is None else "\n".join(kept)
    got = lines.dedup_lines(docs(spark, texts))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    assert got.columns[: len(empty.columns)] == empty.columns and lines.dedup_lines(empty).count() == 0


def test_hot_templates_and_further_rounds(spark, monkeypatch):
    """One template in many lines: its keys are dealt anew by marks and candidates come in rounds, with the same result."""
    r = random.Random(9)
    texts = [(i, f"chapter of the book with number {r.randrange(10**6):06d} and more\nsecond line {r.randrange(300):04d} of it", "s") for i in range(400)]
    plain = {x["doc_id"]: x["text"] for x in lines.dedup_lines(docs(spark, texts)).collect()}
    for name, value in (("HOLD", 2000), ("HOT", 500), ("ROOM", 1), ("PRODUCT", 1000)):
        monkeypatch.setattr(lines, name, value)
    monkeypatch.setattr(lines.shadowed_lines, "__defaults__", (lines.THRESHOLD, 1))
    assert {x["doc_id"]: x["text"] for x in lines.dedup_lines(docs(spark, texts).repartition(5)).collect()} == plain
    first = {}
    for i, t, _ in texts:
        for x in t.split("\n"):
            first.setdefault(x, i)
    order = sorted(first, key=lambda x: (first[x], x))
    bad = {b for k, b in enumerate(order) if any(lines.banded_distance(a, b, 2) <= 2 for a in order[:k])}
    assert plain == {i: "\n".join(x for x in t.split("\n") if x not in bad and first[x] == i) for i, t, _ in texts}


def test_lines_of_odd_rows(spark):
    """Null texts stay null, rows without an id come last, repeated rows are judged alike, clashing columns pass through."""
    line = "a line that is long enough to be near another one"
    rows = [(1, line, "a"), (1, line, "a"), (2, None, "a"), (3, "", "a"), (None, line + "x", "a"), (None, "only here, where no id is", "a"), (4, " \n" + line + "\n\n", "a")]
    got = sorted(map(tuple, lines.dedup_lines(docs(spark, rows)).select("doc_id", "text", "gone", "n_removed").collect()), key=str)
    assert got == sorted([(1, line, "g", 0), (1, line, "g", 0), (2, None, "g", 0), (3, "", "g", 0), (None, "", "g", 1), (None, "only here, where no id is", "g", 0), (4, " \n\n", "g", 1)], key=str)


def test_banded_distance():
    assert [lines.banded_distance(a, b, 2) for a, b in (("", ""), ("abc", "abd"), ("abc", "xyz"), ("abcd", "bcda"), ("a", "aaaa"))] == [0, 1, 3, 2, 3]


def test_toxicity(spark, table, empty):
    r = random.Random(3)
    bad = ["scum", "vile"]
    rows, lab = [], []
    for i in range(300):
        w = sentence(i + 100, 40).split()
        toxic = i % 3 == 0
        if toxic:
            w[r.randrange(40)] = r.choice(bad)
        rows.append((i, " ".join(w), "s"))
        lab.append((i, 1, int(toxic)))
    labels = spark.createDataFrame(lab + [(None, None, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    model = toxicity.fit_toxicity(d, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(d, model).collect()}
    assert all(got[i]["predicted"] == t for i, _, t in lab)
    hit = got[0]["spans"][0]
    assert rows[0][1][hit["start"] : hit["end"]] in bad
    odd = toxicity.score_toxicity(table, model).collect()
    assert len(odd) == len(ROWS) and all(0 <= x["score"] <= 1 for x in odd)
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels.limit(0))).count() == 0


def test_toxicity_by_brute_force(spark):
    """Scores and spans of short texts from all labellings of their words, with the fitted weights."""
    r = random.Random(4)
    rows = [(i, " ".join([*(x := sentence(i, 25).split())[:9], r.choice(["scum", "vile"]) if i % 2 else x[9], *x[10:]]), "s") for i in range(120)]
    model = toxicity.fit_toxicity(docs(spark, rows), spark.createDataFrame([(i, 0, i % 2) for i in range(120)], "doc_id long, quality int, toxic int"))
    texts = ["scum", "you vile scum of it", "a quiet day", "Scum! and then, vile words", "", None, sentence(3, 7)]
    for got, text in zip(toxicity.score_toxicity(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).orderBy("doc_id").coalesce(1), model).orderBy("doc_id").collect(), texts, strict=True):
        w = (text or "").encode().split()
        f = [toxicity.features(x) for x in w]
        e = [model.w[0][f[i]].sum() + (model.w[1][f[i - 1]].sum() if i else 0) + (model.w[2][f[i + 1]].sum() if i + 1 < len(w) else 0) for i in range(len(w))]
        total, one = 0.0, np.zeros(len(w))
        for k in range(2 ** len(w) if w else 0):
            y = np.array([(k >> i) & 1 for i in range(len(w))])
            p = np.exp(model.start[y[0]] + sum(float(np.clip(e[i], -30, 30)) * y[i] for i in range(len(w))) + sum(model.trans[y[i], y[i + 1]] for i in range(len(w) - 1)))
            total, one = total + p, one + p * y
        m = one / total if w else one
        score = 0.0 if not w else m.max() if m.max() < 0.5 else 1 - np.prod(1 - m[m >= 0.5])
        assert got["score"] == pytest.approx(score, abs=1e-5) and got["predicted"] == int(score >= 0.7)
        hit = [i for i in range(len(w)) if m[i] >= 0.5]
        assert sum(x["end"] - x["start"] for x in got["spans"]) >= sum(len(w[i]) for i in hit) and len(got["spans"]) == sum(i - 1 not in hit for i in hit)


def test_toxicity_takes_a_bounded_sample_and_whole_texts(spark):
    long = sentence(1, 400)
    rows = [(i, long + f" w{i}" if i else "x " * 50_000, "s") for i in range(20)]
    labels = spark.createDataFrame([(i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert toxicity.fit_toxicity(docs(spark, rows), labels, sample_bytes=10_000.0) is not None
    f, y, on = toxicity.segments([long.encode().split(), b"a b".split(), []], [[], [1], []])
    assert on.sum() == 402 and y.sum() == 1 and on[:-1].all(1).sum() == 400 // 17
    odd = toxicity.score_toxicity(docs(spark, [(1, long, "s"), (1, long, "s"), (None, "a" * 100_000, "s")]), toxicity.Tagger(toxicity.train_field([], []))).collect()
    assert sorted(str(r["doc_id"]) for r in odd) == ["1", "1", "None"] and {r["predicted"] for r in odd} == {0}


def test_chain_marginals_are_exact():
    r = np.random.default_rng(0)
    e, first, trans, start = r.normal(size=9) * 3, np.zeros(9, bool), r.normal(size=(2, 2)), r.normal(size=2)
    first[[0, 5]] = True
    got = toxicity.chain_marginals(e, first, trans, start)
    for a, b in ((0, 5), (5, 9)):
        total, one = 0.0, np.zeros(b - a)
        for k in range(2 ** (b - a)):
            y = [(k >> i) & 1 for i in range(b - a)]
            w = np.exp(start[y[0]] + sum(e[a + i] * y[i] for i in range(b - a)) + sum(trans[y[i], y[i + 1]] for i in range(b - a - 1)))
            total += w
            one += w * np.array(y)
        assert np.allclose(got[a:b], one / total)


def plain_pseudo_likelihood(texts):
    """The counts in dictionaries, each word's window and experts one by one; the network is taken from the operator's own classes and weights."""
    words = [(t or "").encode().split() for t in texts]
    one, two = Counter(w for d in words for w in d), Counter(p for d in words for p in zip(d, d[1:], strict=False))
    return words, one, two


def test_pseudo_likelihood_by_brute_force(spark, table):
    """Every word's probability from plain counts of the other documents, with the gates and classes of the fitted network."""
    texts = [t for _, t, _ in ROWS]
    blocks = pseudo_lm._blocks(table, Scratch(spark, "t"))
    totals, pairs, net = pseudo_lm.fit_lm(blocks)
    got = {(r["doc_id"], r["n_tokens"]): r for r in pseudo_lm.pseudo_likelihood(table).collect()}
    words, one, two = plain_pseudo_likelihood(texts)
    assert totals.sum() == sum(one.values())
    e, num, bias, out, out_bias = (p.astype(float) for p in net.parts)
    top = sorted(one, key=lambda w: (-one[w], int(pseudo_lm.Words([w]).hash[0] & pseudo_lm._KEY)))[: pseudo_lm.OWN]

    def cls(w):
        if w in top:
            return top.index(w)
        is_letter = lambda b: chr(b).isalpha() or b >= 128
        shape = 3 if not is_letter(w[0]) else 2 if not is_letter(w[-1]) else int(65 <= w[0] <= 90)
        return pseudo_lm.OWN + sum(one[w] >= x for x in pseudo_lm.BANDS) * pseudo_lm.SHAPES + shape

    for (i, _, _), d in zip(ROWS, words, strict=True):
        mine, mine2, total, unseen = Counter(d), Counter(zip(d, d[1:], strict=False)), 0.0, 0
        n = lambda k: one[d[k]] - mine[d[k]] if 0 <= k < len(d) else None  # noqa: B023, E731
        n2 = lambda k: two[d[k], d[k + 1]] - mine2[d[k], d[k + 1]] if 0 <= k < len(d) - 1 else 0  # noqa: B023, E731
        log = lambda x: -2.0 if x is None else -1.0 if x == 0 else float(np.float16(np.log(x)))
        for k, w in enumerate(d):
            h = np.array([log(n(k - 1)), log(n(k + 1))]) / 8 @ num + bias
            for place, at in enumerate((k - 2, k - 1, k + 1, k + 2)):
                h = h + e[place * (pseudo_lm.CLASSES + 1) + (cls(d[at]) if 0 <= at < len(d) else pseudo_lm.CLASSES)]
            s = np.tanh(h) @ out + out_bias
            g = np.exp(s[:4]) * [bool(n(k - 1)), bool(n(k + 1)), 1, 1]
            c = np.exp(s[4:])
            g, c = g / g.sum(), c / c.sum()
            if n(k):
                p = g[0] * n2(k - 1) / max(n(k - 1) or 1, 1) + g[1] * n2(k) / max(n(k + 1) or 1, 1) + g[2] * c[cls(w)] * n(k) / totals[cls(w)]
                total += np.log(p)
            else:
                unseen += 1
                total += np.log(g[3]) + sum(pairs[x, y] for x, y in zip(b"\0" + w, w + b"\0", strict=True))
        r = got[i, len(d)]
        assert r["log_likelihood"] == pytest.approx(total, rel=5e-3, abs=1e-6)
        assert (r["mean_log_prob"] is None) == (not d) and (not d or r["unseen_share"] == pytest.approx(unseen / len(d)))


def test_pseudo_likelihood_hears_order_and_not_layout(spark, empty):
    cycle = ["red", "green", "blue", "black", "white", "brown", "pink", "grey"]
    r = random.Random(1)
    mixed = cycle * 15
    r.shuffle(mixed)
    rows = [(i, " ".join(cycle * 15), "s") for i in range(400)] + [(900, None, "s"), (901, "", "s"), (902, " ".join(mixed), "s"), (None, "red zz\0zz", "s"), (None, "red", "s"), (903, "red", "s"), (903, "red", "s")]
    d = docs(spark, rows)
    got = pseudo_lm.pseudo_likelihood(d.repartition(2)).collect()
    by = {x["doc_id"]: x for x in got}
    assert by[1]["mean_log_prob"] > -0.5 and by[1]["mean_log_prob"] > by[902]["mean_log_prob"] + 0.5 and by[1]["context_gain"] > by[902]["context_gain"]
    assert by[900]["n_tokens"] == by[901]["n_tokens"] == 0 and by[900]["mean_log_prob"] is None and by[900]["log_likelihood"] == 0 and len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, pseudo_lm.pseudo_likelihood(d.repartition(9)).collect()))
    assert pseudo_lm.pseudo_likelihood(empty).count() == 0


def test_pseudo_likelihood_of_blocks_without_words(spark):
    """A block of empty texts alone: a whole table of them, or those that come after a text longer than a block."""
    blank = [(1, None, "s"), (2, "", "s"), (None, " \n", "s")]
    long = (0, "a b " * (pseudo_lm.BLOCK // 2 + 1), "s")
    for rows in (blank, [long, *blank[:2]]):
        got = {r["doc_id"]: r for r in pseudo_lm.pseudo_likelihood(docs(spark, rows)).collect()}
        assert len(got) == len(rows) and all(got[i]["n_tokens"] == 0 == got[i]["log_likelihood"] and got[i]["mean_log_prob"] is None for i, _, _ in rows if i != 0)
        assert 0 not in got or got[0]["n_tokens"] == pseudo_lm.BLOCK + 2 and got[0]["unseen_share"] == 1


def plain_step(parts, cls, own, pair, totals, rate):
    """One first step over the words of one document by the plain formulas, a row for each word; sums of squares start at 1e-4."""
    e, num, bias, out, out_bias = parts
    n, experts, side, width = len(cls), pseudo_lm.EXPERTS, pseudo_lm.SIDE, pseudo_lm.CLASSES + 1
    around, both = np.full((n, 2), -2, np.float32), np.full((n, 2), -1, np.float32)
    around[1:, 0], around[:-1, 1], both[1:, 0], both[:, 1] = own[:-1], own[1:], pair[:-1], pair
    known, rows = own >= 0, np.arange(n)
    ex = np.zeros((n, experts), np.float32)
    ex[:, :2] = np.where((both >= 0) & (around >= 0), np.exp(np.minimum(both - around, 0)), 0)
    ex[:, 2] = np.where(known, np.exp(np.minimum(own - np.log(totals).astype(np.float32)[cls], 0)), 0)
    ex[:, 3] = ~known
    padded = np.concatenate(([width - 1] * side, cls, [width - 1] * side))
    near = [padded[side + d : side + d + n] + width * k for k, d in enumerate(d for d in range(-side, side + 1) if d)]

    def step():
        h = around / 8 @ num + bias
        for x in near:
            h += e[x]
        h = np.tanh(h)
        s = h @ out + out_bias
        g, c = np.exp(s[:, :experts] - s[:, :experts].max(1, keepdims=True)), np.exp(s[:, experts:] - s[:, experts:].max(1, keepdims=True))
        g[:, :2] *= around >= 0
        g, c = g / g.sum(1, keepdims=True), c / c.sum(1, keepdims=True)
        r = g * ex
        r[:, 2] *= c[rows, cls]
        r /= r.sum(1, keepdims=True)
        d = np.concatenate((r - g, -c * r[:, 2:3]), 1)
        d[rows, experts + cls] += r[:, 2]
        d /= n
        gh = (d @ out.T) * (1 - h * h)
        ge = np.zeros(e.shape, np.float32)
        for k, x in enumerate(near):
            one = np.zeros((n, width), np.float32)
            one[rows, x - k * width] = 1
            ge[k * width : (k + 1) * width] = one.T @ gh
        return [x + rate * y / np.sqrt(np.float32(1e-4) + y * y) for x, y in zip(parts, (ge, (around / 8).T @ gh, gh.sum(0), h.T @ d, d.sum(0)), strict=True)]

    return step


def test_pseudo_likelihood_steps_by_plain_formulas_in_less_time():
    """Training has the query's largest share of CPU time: a step moves the weights as the plain formulas do, in clearly less time of the same thread."""
    rng, n = np.random.default_rng(5), pseudo_lm.STEP
    cls = rng.integers(0, pseudo_lm.CLASSES, n)
    own, pair = (np.where(rng.random(n) < 0.2, -1, np.log(rng.integers(1, 9, n) * x)).astype(np.float16) for x in (10, 1))
    pair[-1] = -1
    totals = rng.integers(1000, 9000, pseudo_lm.CLASSES).astype(float)
    block = pseudo_lm.Block(np.array([n]), cls.astype(np.uint8).tobytes(), own.tobytes(), pair.tobytes(), b"", totals, None)
    start = pseudo_lm.Network().flat() + rng.normal(0, 0.3, sum(pseudo_lm._SIZES)).astype(np.float32)
    net = pseudo_lm.Network(start.copy())
    plain = plain_step([p.copy() for p in net.parts], cls, own.astype(np.float32), pair.astype(np.float32), totals, 0.1)

    def step():
        net = pseudo_lm.Network(start.copy())
        net.step(block, slice(0, n), [np.full(s, 1e-4, np.float32) for s in pseudo_lm._SHAPES], 0.1)
        return net.parts

    for a, b in zip(step(), plain(), strict=True):
        assert np.allclose(a, b, atol=1e-4)

    def time_of(f):
        t = time.thread_time()
        for _ in range(50):
            f()
        return time.thread_time() - t

    took = [(time_of(step), time_of(plain)) for _ in range(5)]
    assert min(a for a, _ in took) < 0.75 * min(b for _, b in took), took


def test_words_without_objects():
    texts = [b" a bb\n\nccc", None, b"", b"\t\x0b", b"d\x00e \xc3\xa9\x0cf", b"a"]
    w = Words(texts)
    assert w.some(np.arange(len(w))) == [x for t in texts for x in (t or b"").split()] and w.lengths.tolist() == [len((t or b"").split()) for t in texts]
    assert w.hash[0] == w.hash[-1] and len(set(w.hash.tolist())) == len(w) - 1 and len(Words([])) == 0 == len(Words([None]))


def test_substrings_by_brute_force(spark, table, empty):
    low, n = {}, 13
    for i, t, _ in ROWS:
        w = words(t)
        for s in range(len(w) - n + 1):
            if i is not None:
                g = tuple(w[s : s + n])
                low[g] = min(low.get(g, i), i)
    want = []
    for i, t, _ in ROWS:
        w = words(t)
        gone = {s + k for s in range(len(w) - n + 1) if i is not None and low[tuple(w[s : s + n])] < i for k in range(n)}
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    got = [tuple(r)[:4] for r in substrings.dedup_substrings(table).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and substrings.dedup_substrings(empty).count() == 0


def test_equal_windows_have_equal_representatives():
    r = np.random.default_rng(4)
    a, b = (r.integers(0, 6, 400).astype(np.uint64) for _ in range(2))
    b[100:180] = a[37:117]
    keys = [dict(zip(*[x.tolist() for x in substrings.window_keys(v, np.zeros(400, int))[:2]], strict=True)) for v in (a, b)]
    assert all(keys[0][37 + i] == keys[1][100 + i] for i in range(80 - 12))


def test_jaccard(spark, table, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_sets(table).collect()}
    assert {(1, 58, 1), (2, 58, 1), (3, 59, 1), (4, 0, 4), (5, 0, 5), (7, 1, 7), (None, 58, None), (8, 0, 8)} <= got
    assert jaccard.similar_sets(empty).count() == 0


def test_jaccard_of_odd_rows(spark):
    """A very long text beside its copy, texts of one n-gram, sets of many equal words, a link on the bound, rows of one id."""
    long, ten = sentence(60, 40_000), [f"w{i}" for i in range(12)]
    rows = [(1, long, "s"), (2, long + " end", "s"), (3, "a b", "s"), (4, "A  B", "s"), (5, "a b c", "s"), (6, "x " * 500, "s"), (7, "x " * 9, "s"), (8, " ".join(ten), "s"), (9, " ".join(ten[:11]), "s"), (9, " ".join(ten[:11]), "s")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_sets(docs(spark, rows)).collect())
    assert [x for x in got if x[0] > 2] == [(3, 1, 3), (4, 1, 3), (5, 1, 5), (6, 1, 6), (7, 1, 6), (8, 10, 8), (9, 9, 8), (9, 9, 8)]
    assert [x[2] for x in got[:2]] == [1, 1]


def test_cut_stars_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 300)
    r, base, rows = random.Random(8), sentence(50, 60).split(), []
    for i in range(40):
        w = base[:]
        for _ in range(r.randint(0, 2)):
            w[r.randrange(60)] = f"edit{i}"
        rows.append((i, " ".join(w), "s"))
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (t.split() for _, t, _ in rows)]
    comp = list(range(40))
    for _ in range(40):
        for a in range(40):
            for b in range(40):
                if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert {r["doc_id"]: r["component_id"] for r in jaccard.similar_sets(docs(spark, rows)).collect()} == dict(enumerate(comp))


def test_mixing(spark, table, empty):
    rep = mixing.mix_report(table).collect()
    assert len(rep) == len(ROWS) and all(r["taken"] <= 3 * r["size"] for r in rep)
    by = {}
    for r in rep:
        k = (r["source_size"], r["target"])
        by[k] = by.get(k, 0) + r["taken"]
    assert all(abs(v - k[1]) <= 4 for k, v in by.items())
    assert sorted(map(str, rep)) == sorted(map(str, mixing.mix_report(table.repartition(5)).collect()))
    out = mixing.mix_sources(table)
    assert out.columns == table.columns and sum(len(words(r["text"])) for r in out.collect()) == sum(r["taken"] for r in rep)
    assert mixing.mix_sources(empty).count() == 0 == mixing.mix_report(empty).count()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id long, v string")


def test_neighbours_by_brute_force(spark):
    r = np.random.default_rng(2)
    hub = r.normal(size=16)
    rows = [(i, [float(x) for x in (hub + r.normal(size=16) * 0.15 if i % 3 == 0 else r.normal(size=16))], i % 2, 0, "") for i in range(300)]
    rows += [(400, rows[0][1], 0, 0, ""), (401, None, 0, 0, ""), (402, [0.0] * 16, 0, 0, ""), (403, [float("nan")] * 16, 0, 0, ""), (404, rows[0][1], None, 0, ""), (405, [1.0, None], 0, 0, "")]
    ok = [x for x in rows if x[0] <= 400]
    u = np.array([x[1] for x in ok])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    lab = np.array([x[2] for x in ok])
    link = (u @ u.T >= 0.93) & (lab[:, None] == lab)
    np.fill_diagonal(link, False)
    got = {x["vec_id"]: x for x in neighbours.near_vectors(vectors(spark, rows)).collect()}
    assert len(got) == len(rows) and all(got[x[0]]["n_links"] == link[k].sum() for k, x in enumerate(ok))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(401, 406))
    assert neighbours.near_vectors(vectors(spark, [])).count() == 0


def test_neighbours_of_odd_rows(spark):
    """Labels of any type, null and repeated ids, a cosine that is just reached."""
    c = 0.93
    rows = [(1, [1.0, 0.0], "a"), (2, [c, float(np.sqrt(1 - c * c)) * (1 - 1e-9)], "a"), (2, [0.0, -1.0], "a"), (3, [1.0, 0.0], "b"), (None, [1.0, 0.0], "a"), (5, [2.0, 0.0], "b"), (6, [-0.0, 1.0], "c"), (7, [0.0, 1.0], "c")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in neighbours.near_vectors(d).collect())
    assert got == sorted([("1", 1, "1"), ("2", 1, "1"), ("2", 1, "1"), ("3", 1, "3"), ("None", 0, "None"), ("5", 1, "3"), ("6", 1, "6"), ("7", 1, "6")])
    for kind in ("double", "boolean", "date"):
        value = {"double": F.col("n").cast("double"), "boolean": F.col("n") > 0, "date": F.date_add(F.lit("2024-01-01").cast("date"), F.col("n").cast("int"))}[kind]
        e = spark.createDataFrame([(i, [1.0, 0.0], i % 2) for i in range(4)], "vec_id long, embedding array<double>, n int").withColumn("label", value)
        assert {r["vec_id"]: r["component_id"] for r in neighbours.near_vectors(e).collect()} == {0: 0, 1: 1, 2: 0, 3: 1}


def test_dense_groups_that_link_only_across(spark):
    """20 vectors each, 0.99 inside and 0.935 across: every list of K is full of its own group."""
    e, cos = np.eye(64), 0.935 / 0.99
    centres = e[0], cos * e[0] + np.sqrt(1 - cos * cos) * e[1]
    x = [np.sqrt(0.99) * centres[i // 20] + np.sqrt(0.01) * e[2 + i] for i in range(40)] + [e[50], e[51], 0.99 * e[50] + np.sqrt(1 - 0.99**2) * e[52]]
    got = {r["vec_id"]: r for r in neighbours.near_vectors(vectors(spark, [(i, [float(c) for c in v], 1, 0, "") for i, v in enumerate(x)])).collect()}
    assert all(got[i]["n_links"] == 39 and got[i]["component_id"] == 0 for i in range(40)) and sum(got[i]["kept"] for i in range(40)) == 1
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in (40, 41, 42)] == [(1, 40), (0, 41), (1, 40)]


def test_small_groups_beside_a_hot_one(spark, monkeypatch):
    """The search finds the hot group only: its links must not outvote five pairs, after the last try either."""
    e = np.eye(160)
    x = [np.sqrt(0.99) * e[0] + np.sqrt(0.01) * e[1 + i] for i in range(100)] + [y for i in range(5) for y in (e[110 + i], 0.95 * e[110 + i] + np.sqrt(1 - 0.95**2) * e[120 + i])]
    found = spark.createDataFrame([(a, (a + d) % 100, 0.99) for a in range(100) for d in range(1, 9)], neighbours.EDGE)
    monkeypatch.setattr(neighbours, "_block_edges", lambda *a, **b: found)
    monkeypatch.setattr(neighbours, "TRIES", 1)
    got = {r["vec_id"]: r for r in neighbours.near_vectors(vectors(spark, [(i, [float(c) for c in v], 1, 0, "") for i, v in enumerate(x)])).collect()}
    assert all(got[i]["n_links"] == 99 for i in range(100)) and all((got[i]["n_links"], got[i]["component_id"]) == (1, i - i % 2) for i in range(100, 110))


def test_trees_grow_with_the_label(spark):
    sizes = neighbours._label_sizes(spark.range(1 << 20).select((F.col("id") == 0).cast("long").alias("lab")), 0.93)
    assert {r["lab"]: (r["bits"], r["trees"]) for r in sizes.collect()} == {1: (0, 4), 0: (12, 15)}


def test_bpe_equals_the_library(spark, table, empty):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(tokenizer_path()), bpe.WordBpe(tokenizer_path())
    r = random.Random(12)
    pools = ["abcXYZ '’.,!?0189-_", "éèüßñçÀÖ ", "ΑΣςσοδ ", "日本語テキスト한국어 ", "абвгдЖЗ ", "🙂👍🏽‍👩 ", "\u0301\u200d\u00a0\u2028\t\n\r ", "ﬁ²½①Ⅷ٣ "]
    texts = ["", "Hello WORLD's don't <|endoftext|>x", "ΑΣ ΟΔΟΣ é é 123!!", BASE, "a" * 500, "\x00 \x1f \x85", "we'll they've I'm it'S"]
    texts += ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(1, 60))) for _ in range(400)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        n, joined, decoded = own.digest(t)
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
        assert (n, joined.decode(), decoded.decode()) == (len(ids), " ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False))
    got = bpe.bpe_encode(table, tokenizer_path())
    assert got.count() == len(ROWS) and all(r["n_tokens"] == len(r["ids"]) for r in got.collect()) and bpe.bpe_encode(empty, tokenizer_path()).count() == 0


def test_bpe_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 10)
    own = bpe.WordBpe(tokenizer_path())
    for k in range(100):
        own.digest(f"word{k} " + "y" * (bpe.KEPT + 1 + k))
    assert max(map(len, (own.young, own.old, own.known))) <= 10 and max(map(len, own.young)) <= bpe.KEPT


def test_quality(spark, table, empty):
    rows = [(i, sentence(i, 50) if i % 2 else "!!! BUY | " * 30, "s") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    model = quality.fit_quality(d, labels)
    assert all((r["quality_score"] >= quality.CUT) == bool(r["doc_id"] % 2) for r in quality.score_quality(d, model).collect())
    assert quality.score_quality(table, model).columns == [*table.columns, "quality_score"] and quality.score_quality(empty, quality.fit_quality(empty, labels)).count() == 0


def test_quality_by_brute_force(spark):
    """Moments of each class, shrinkage and densities in plain numpy; a clashing column is replaced, labels may come twice or be of one class."""
    rows = [(i, (sentence(i, 20 + i % 40) if i % 3 else "!!! BUY | 55 " * (5 + i % 7)) + ("." if i % 5 else ""), "s") for i in range(150)] + [(200, None, "s"), (201, "", "s"), (3, "again", "s")]
    lab = [(i, int(bool(i % 3)), 0) for i in range(150)] + [(None, 1, 0), (4, None, 0), (7, 1, 0)]
    labels = spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    d = docs(spark, rows).withColumn("Quality_Score", F.lit("mine"))
    got = {(r["doc_id"], r["text"]): r["quality_score"] for r in quality.score_quality(d, quality.fit_quality(d, labels)).collect()}
    x = {y: np.array([quality.document_stats((t or "").encode()) for i, t, _ in rows for j, q, _ in lab if i == j and q == y and not quality.held_out_id(i, 4, 2)]) for y in (0, 1)}
    cov = {y: np.cov(v.T, bias=True) for y, v in x.items()}
    n = {y: len(v) for y, v in x.items()}
    pooled = sum(n[y] * cov[y] for y in x) / sum(n.values())
    for i, t, _ in rows:
        odds = np.log(n[1] / n[0])
        for y, sign in ((0, -1), (1, 1)):
            near = 0.05 + 0.95 * quality.DIM / (n[y] + quality.DIM)
            c = (1 - near) * cov[y] + near * pooled
            c = 0.98 * c + 0.02 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(quality.DIM)
            z = np.array(quality.document_stats((t or "").encode())) - x[y].mean(0)
            odds += sign * (-0.5 * z @ np.linalg.solve(c, z) - 0.5 * np.linalg.slogdet(c)[1])
        assert got[i, t] == pytest.approx(1 / (1 + np.exp(-np.clip(odds, -500, 500))), abs=1e-6)
    one = quality.fit_quality(d, labels.where("quality = 1"))
    assert {round(r["quality_score"], 9) for r in quality.score_quality(d, one).collect()} == {round(1 / (1 + np.exp(-one.prior)), 9)} and one.prior > 0


def test_top_k_of_odd_rows(spark):
    """Null ids take no part, a repeated candidate counts each time, a repeated query once, by its smallest vector."""
    rows = [(None, [9.0, 9.0], 0, 0, ""), (50, [1.0, 0.0], 0, 0, ""), (50, [0.0, 1.0], 0, 0, ""), (1, [2.0, 0.0], 0, 0, ""), (2, [0.0, 3.0], 0, 0, ""), (2, [0.0, 3.0], 0, 0, ""), (3, [1.0], 0, 0, ""), (4, [], 0, 0, "")]
    got = [tuple(r) for r in topk.top_k(vectors(spark, rows).repartition(3), "vec_id % 50 = 0", 5).orderBy("rank").collect()]
    assert got == [(50, 1, 2, 3 * 65536), (50, 2, 2, 3 * 65536), (50, 3, 1, 0)]


def test_top_k(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.round(r.normal(size=4), 1)], 0, 0, "") for i in range(120)]
    rows += [(200 + i, rows[50][1], 0, 0, "") for i in range(8)] + [(300, None, 0, 0, ""), (350, [1.0, None, 0.0, 0.0], 0, 0, ""), (400, [float("inf")] * 4, 0, 0, "")]
    want = topk.pandas_top_k({x[0]: x[1] for x in rows if x[0] < 300}, [0, 50, 100, 200], 5)
    got = topk.top_k(vectors(spark, rows), "vec_id % 50 = 0", 5)
    assert sorted(map(tuple, got.collect())) == sorted(want.itertuples(index=False, name=None))
    assert topk.top_k(vectors(spark, []), "vec_id % 50 = 0", 5).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(10, 30)] + [(5, 99), (7, 7), (99, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(e, Scratch(spark, "t")).collect()}
    assert got == {i: 10 for i in range(10, 31)} | {5: 5, 99: 5}
