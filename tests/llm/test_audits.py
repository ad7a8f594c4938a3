"""Filter audit, SimHash and source divergence against brute force, on tables with nulls, empties, ties, repeats and clashing columns."""

import collections
import itertools
import random
import re

import pytest
import xxhash

from oscillar.llm import divergence, filter_audit, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "doc_id long, text string, lang string, source string, content string, words string, row long, mask int, cells string, n long, part string, term string, value long, fp long, key long"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    names = ["the", "of", "Ärger", "straße", "x1y", "UP", "日本", "a-b"] + ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(150)]
    say = lambda n, k=158: " ".join(rng.choice(names[:k]) for _ in range(n))
    base = say(80)
    texts = [base] * 5 + [base.replace(names[9], "zz", 1) for _ in range(3)] + [say(rng.randint(1, 120), rng.choice([6, 30, 158])) for _ in range(90)]
    texts += [None, "", "", " \n\t", "a", "A b", "LOUD WORDS " * 40, "cost $5 | 7%", "the the the", say(30_000), "\x00nul a", "\x85nel x", "😀 ok 😀"]
    out = [(k, t, rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s1", "s0", "s2", None, ""]), None) for k, t in enumerate(texts)]
    out += [(None, base, "en", "s0", 1), (None, "no id", None, None, 1), (3, base, "en", "s1", 1), (200, "alone", "xx", "lonely", 1), (201, None, "xx", "other", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(5).cache()


def flags_of(labels, place):
    out = collections.defaultdict(int)
    for r in labels:
        out[r[0]] = max(out[r[0]], int(r[place] == 1))
    return out


def audit(rows, labels):
    """Every order applied to every row, one filter after the other."""
    good, toxic = flags_of(labels, 1), flags_of(labels, 2)
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = collections.defaultdict(list)
    for i, t, _, source, _ in rows:
        t = t or ""
        ws = WORD.findall(t)
        fails = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts[source or ""].append((fails, i is not None and good[i], i is not None and toxic[i]))
    out = {}
    for part, held in parts.items():
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = held
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[0][x]]
                left = [r for r in left if not r[0][x]]
                failing = [r for r in held if r[0][x]]
                only = sum(sum(r[0].values()) == 1 for r in failing)
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), only, sum(map(int, (r[1] for r in gone))), sum(map(int, (r[2] for r in gone)))]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


LABELS = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 90, 2)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (200, None, 1), (9999, 1, 1)]


def test_filter_audit(spark, docs, rows):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.filter_audit(docs, labels).collect()}
    assert got == audit(rows, LABELS)


def test_filter_audit_of_own_filters(spark, docs, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs, labels, filters={"X": "content = ''", "Y": "size(words) > 40"}, copies="").collect()
    assert {r.filter_order for r in got} == {"XY", "YX"} and all(r.good_lost == r.toxic_lost == 0 for r in got)
    mine = [t or "" for _, t, _, s, _ in rows if (s or "") == "s0"]
    first = next(r for r in got if (r.part, r.filter_order, r.step) == ("s0", "XY", 1))
    assert (first.removed, first.kept) == (sum(not t for t in mine), sum(bool(t) for t in mine))
    with pytest.raises(ValueError):
        filter_audit.filter_audit(docs, labels, copies="A")


def test_filter_audit_of_a_hot_id_and_text(spark):
    """A third of the rows has one id, another third one text."""
    rows = [(7, f"text {k}", None, "s", None) for k in range(3000)] + [(100 + k, "same text", None, "s" if k % 2 else "t", None) for k in range(3000)] + [(10_000 + k, f"other {k}", None, "t", None) for k in range(3000)]
    labels = [(7, 1, 1), (100, 1, 0), (101, 1, 0), (102, 0, 1)]
    got = filter_audit.filter_audit(spark.createDataFrame(rows, KIND), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == audit(rows, labels)


def shingles(text):
    ws = WORD.findall(lowered(text))
    return [" ".join(ws[k : k + 3]) for k in range(max(len(ws) - 2, 1))] if ws else []


def plain_fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(marks, radius):
    """marks: (id, fingerprint) rows → sorted (id, fingerprint, smallest id of the component)."""
    fps = sorted({f for _, f in marks})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            parent[root(a)] = root(b)
    least = {}
    for i, f in marks:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return sorted(((i, f, least.get(root(f))) for i, f in marks), key=str)


def test_simhash(docs, rows):
    got = simhash.simhash_dedup(docs).collect()
    want = classes([(i, plain_fingerprint(t)) for i, t, *_ in rows], 2)
    assert sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got), key=str) == want
    assert all(len(r.fingerprint) == 16 for r in got)


def test_masks_cover_every_pair_of_bits():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for bits in itertools.combinations(range(64), radius):
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


@pytest.mark.parametrize(("radius", "bucket"), [(2, 32), (2, 2), (1, 32), (1, 2)])
def test_near_pairs_connect_what_links(spark, radius, bucket):
    """Chains, stars and balls of fingerprints, in buckets small and large."""
    rng = random.Random(radius * 100 + bucket)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(40):
            fps.add(at)
            at ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])))
    centre = rng.getrandbits(64)
    fps |= {centre ^ 1 << a ^ 1 << b for a, b in itertools.combinations(range(0, 64, 3), 2)}
    table = spark.createDataFrame([(simhash.as_signed(f),) for f in fps], "fp long")
    pairs = [(r.a, r.b) for r in simhash.near_pairs(table, radius, bucket).collect()]
    assert all((a ^ b) & ((1 << 64) - 1) for a, b in pairs) and all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius for a, b in pairs)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a % (1 << 64))] = root(b % (1 << 64))
    want = {i: c for i, _, c in classes([(f, f) for f in fps], radius)}
    least = {}
    for f in sorted(fps):
        least.setdefault(root(f), f)
    assert {f: least[root(f)] for f in fps} == want


def test_long_texts_have_the_fingerprint_of_all_their_shingles():
    text = " ".join(f"w{k % 977}" for k in range(70_000))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def report(rows, top=200):
    texts = [(x or "", s or "", TERM.findall(lowered(t))) for _, t, x, s, _ in rows]
    seen = collections.defaultdict(int)
    for x, _, ts in texts:
        for t in set(ts):
            seen[x, t] += 1
    counts = collections.defaultdict(collections.Counter)
    for x, s, ts in texts:
        counts[x, s].update(t for t in ts if seen[x, t] >= 3)
    out = []
    for x in {g[0] for g in counts}:
        kept = [t for y, t in seen if y == x and seen[y, t] >= 3]
        mine = {s: c for (y, s), c in counts.items() if y == x}
        chance = lambda c, n, v: 1 + 1_000_000_000 * (c + 1) // (n + v)
        p = {s: {t: chance(c[t], sum(c.values()), len(kept)) for t in kept} for s, c in mine.items()}
        whole = sum(mine.values(), collections.Counter())
        q = {t: chance(whole[t], sum(whole.values()), len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in mine.items():
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in mine if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if c[t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda v: (-v[0], v[1].encode()))
                out += [(x, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("top", [200, 3, 1])
def test_source_divergence(docs, rows, top):
    got = divergence.source_divergence(docs, top=top)
    assert sorted(map(tuple, got.collect())) == report(rows, top)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"


def test_source_divergence_without_broadcasts_and_in_small_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(divergence, "FEW", -1)
    monkeypatch.setattr(divergence, "PAIRS", 3)
    assert sorted(map(tuple, divergence.source_divergence(docs).collect())) == report(rows)


def test_probabilities_are_exact_for_large_counts(spark):
    n = 7 * 10**14 + 123
    got = spark.range(1).select(divergence.probability(f"{n}L", f"{3 * n + 1}L", "1000003L")).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (3 * n + 1 + 1000003)


def test_empty_tables_and_clashing_columns(spark, rows):
    none = spark.createDataFrame([], KIND)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(none, labels).count() == simhash.simhash_dedup(none).count() == divergence.source_divergence(none).count() == 0
    few = rows[:12] + rows[88:104]
    clashing = spark.createDataFrame([(i, t, x, s, "c", "w", 1, 2, "y", 3, "p", "t", 4, 5, 6) for i, t, x, s, _ in few], CLASHING)
    odd = labels.selectExpr("*", "1 AS n", "'s' AS part", "2 AS mask")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.filter_audit(clashing, odd).collect()}
    assert got == audit(few, LABELS)
    marks = simhash.simhash_dedup(clashing).collect()
    assert sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in marks), key=str) == classes([(i, plain_fingerprint(t)) for i, t, *_ in few], 2)
    assert sorted(map(tuple, divergence.source_divergence(clashing).collect())) == report(few)
