"""The corpus operators against brute force on small tables, with nulls, empty texts, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import inspect
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspan.llm import decontaminate, jaccard_join, language_id, licence_scan, line_dedup, linking, quality_rules, site_quality, suffix_dedup, token_mix, url_rules
from cellspan.llm.common import cut, numbered, shingle_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORDS = [a + b for a in ("lo", "mi", "ta", "re", "su") for b in ("ne", "ka", "vo", "shi", "pul")]


def prose(rng, n, line=12):
    return "\n".join(" ".join(rng.choice(WORDS) for _ in range(min(line, n - k))) for k in range(0, n, line))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(30, 220)) for _ in range(40)]
    texts = list(base)
    for t in base[:14]:  # copies, near copies, shared passages
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts += [t, " ".join(words), prose(rng, 20) + "\n" + t[: len(t) // 2]]
    texts += [None, "", " \n\t", "one", "ONE", "é" * 150, "é" * 150, "x" * 400, "x" * 250, base[0].upper(), "a\n\nb\n", "dup line here ok\n" * 6, prose(rng, 3000)]
    rng.shuffle(texts)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), 0) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, base[1], "en", "s1", 0)]


@pytest.fixture(scope="module")
def docs(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("c") / "documents.parquet")
    spark.createDataFrame(corpus, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("e") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def numbered_rows(docs):
    """Rows in the order that decides: id (nulls last), then row number."""
    rows = numbered(docs).collect()
    return sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r["__cs_rid"]))


def split(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_suffix_dedup(docs, empty):
    for least in (100, 60):
        seen, want = set(), []
        for r in numbered_rows(docs):
            b = (r.text or "").encode()
            gone = bytearray(len(b))
            for s in range(len(b) - least + 1):
                w = b[s : s + least]
                if w in seen:
                    gone[s : s + least] = b"\1" * least
                seen.add(w)
            kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
            spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
            want.append((r.doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
        out = suffix_dedup.remove_repeats(docs.withColumn("ident", F.lit(1)), least=least, keep_text=True).collect()
        assert sorted(map(repr, ((*r[:5], bytes(r.kept)) for r in out))) == sorted(map(repr, want))
        assert sum(w[2] for w in want) > 1000
    assert suffix_dedup.remove_repeats(empty).count() == 0
    for least in (20, 9000):
        with pytest.raises(ValueError, match="least"):
            suffix_dedup.remove_repeats(docs, least=least)


def test_suffix_dedup_of_very_long_texts(spark):
    rng = random.Random(21)
    long = prose(rng, 60_000)  # above one piece
    rows = [(2, long), (1, "start " + long[1000:200_000] + " end"), (3, long[-900:] * 3), (3, "é" * 200_000), (None, long)]
    for least in (100, 300):
        seen, want = set(), []
        for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            b = t.encode()
            gone = bytearray(len(b))
            for s in range(len(b) - least + 1):
                w = hash(b[s : s + least])
                if w in seen:
                    gone[s : s + least] = b"\1" * least
                seen.add(w)
            want.append((i, len(b), sum(gone)))
        got = [tuple(r)[:3] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), least=least).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_row_numbers_do_not_depend_on_the_tasks(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5000).repartition(7).write.parquet(path)
    number = lambda: {r.id: r["__cs_rid"] for r in numbered(spark.read.parquet(path)).collect()}
    before = number()
    had = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("2k", "64k", "1g"):
            for k in had:
                spark.conf.set(k, size)
            assert number() == before
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)
    assert len(set(before.values())) == 5000


def line_key(line):
    return " ".join(split(lower(line)))


def test_line_dedup(docs, empty):
    rows = numbered_rows(docs)
    spots, names = [], {}
    for d, r in enumerate(rows):
        for k, line in enumerate(r.text.split("\n") if r.text is not None else []):
            if split(line):
                spots.append((d, k, names.setdefault(line_key(line), len(names))))
    sets = [line_dedup.shingle_set(n) for n in names]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    first, gone = set(), defaultdict(set)
    for d, k, n in spots:
        if find(n) in first:
            gone[d].add(k)
        first.add(find(n))
    want = [(r.doc_id, None if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[d]), len(gone[d])) for d, r in enumerate(rows)]
    out = line_dedup.dedup_lines(docs.withColumn("n_lines", F.lit("clash"))).collect()
    assert sorted(map(repr, ((r.doc_id, r.text, r.n_removed) for r in out))) == sorted(map(repr, want))
    assert sum(map(len, gone.values())) > 50
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_signatures_find_most_similar_lines():
    rng, met, tried = random.Random(1), 0, 0
    for _ in range(300):
        n = rng.choice([20, 60, 75, 200])
        a = "".join(rng.choice("abcdefghij ") for _ in range(n)).strip() or "a"
        at = rng.randrange(len(a))
        b = a[:at] + "#" + a[at + 1 :]
        p, q = line_dedup.shingle_set(a), line_dedup.shingle_set(b)
        if len(p & q) >= 0.8 * len(p | q):
            text = np.frombuffer(f"{a}\n{b}\n".encode(), np.uint8)
            keys, owner = line_dedup.band_keys(text, np.array([0, 1]), 16, 8)
            tried += 1
            met += bool(set(keys[owner == 0]) & set(keys[owner == 1]))
    assert tried > 150 and met >= 0.95 * tried


@pytest.mark.parametrize("size", [40, 70, 80, 100, 160, 400])
def test_line_signatures_lose_few_pairs_at_the_threshold(size):
    options = inspect.signature(line_dedup.dedup_lines).parameters
    rng, pairs, shared, texts = random.Random(size), 500, round(2 * size * 0.8 / 1.8 + 0.49), []
    for _ in range(pairs):
        a, b = ([chr(rng.randrange(0x4E00, 0x9000)) for _ in range(size + 4)] for _ in range(2))
        texts += ["".join(a), "".join(a[: shared + 4] + b[shared + 4 :])]
    p, q = map(line_dedup.shingle_set, texts[:2])
    assert 0.8 <= len(p & q) / len(p | q) < 0.83
    keys, owner = line_dedup.band_keys(np.frombuffer(("\n".join(texts) + "\n").encode(), np.uint8), np.arange(2 * pairs), options["bands"].default, options["rows"].default)
    by = [set() for _ in texts]
    for k, o in zip(keys.tolist(), owner.tolist(), strict=True):
        by[o].add(k)
    assert sum(bool(by[i] & by[i + 1]) for i in range(0, 2 * pairs, 2)) >= 0.99 * pairs


def test_repetitive_lines_of_any_length_meet(spark):
    pairs = [("=" * 50, "=" * 90), ("-" * 40, "-" * 100), ("ha " * 20, "ha " * 40), ("=" * 8, "=" * 3000), ("| --- " * 9, "| --- " * 200)]
    for a, b in pairs:
        a, b = a.strip(), b.strip()
        assert line_dedup.shingle_set(a) == line_dedup.shingle_set(b)
        keys, owner = line_dedup.band_keys(np.frombuffer(f"{a}\n{b}\n".encode(), np.uint8), np.array([0, 1]), 16, 8)
        assert set(keys[owner == 0]) == set(keys[owner == 1])
    table = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs[1:3]) for k in (0, 1)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in line_dedup.dedup_lines(table).collect()) == [(0, 0), (1, 1), (2, 0), (3, 1)]


def test_lines_of_few_shingles_are_signed_by_their_distinct_ones(monkeypatch):
    signed, sign = [], line_dedup.many_permutations
    monkeypatch.setattr(line_dedup, "many_permutations", lambda h, counts, *rest: signed.append(len(h)) or sign(h, counts, *rest))
    lines = ["ha " * 2000 + "x", "=" * 5000, "a line of its own", "ab" * 500]
    line_dedup.band_keys(np.frombuffer(("\n".join(lines) + "\n").encode(), np.uint8), np.arange(4), 24, 6)
    assert sum(signed) == sum(len(line_dedup.shingle_set(x)) for x in lines)


def test_a_pair_of_lines_that_shares_many_bands_is_tried_once(spark, monkeypatch):
    rng, seen, resolve = random.Random(5), [], line_dedup.resolve

    def spy(buckets, verify, marks, allow, same, pairs=None):
        def counted(p):
            seen.append(p.count())
            return verify(p)

        seen.append(buckets.count())
        return resolve(buckets, counted, marks, allow, same, pairs)

    monkeypatch.setattr(line_dedup, "resolve", spy)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(120)).strip() for _ in range(6)]
    table = spark.createDataFrame([(f"{k}{i}", f"{k}\n" + line + k) for i, line in enumerate(lines) for k in "xy"], "doc_id string, text string")
    out = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(table).collect()}
    assert seen == [0, 6]  # no buckets, and six pairs
    assert out == {f"{k}{i}": (k == "x" and i > 0) + (k == "y") + (k == "y" and i > 0) for i in range(6) for k in "xy"}


def test_pairs_near_the_bound_are_decided_by_their_shingles():
    rng, same = random.Random(7), line_dedup.Same(Fraction(4, 5))
    for letters in ("ab c", "abcdeé中\U0001f600", [chr(0x4E00 + k) for k in range(9000)]):
        xs, ys = [], []
        for _ in range(400):
            x = [rng.choice(letters) for _ in range(rng.randrange(1, 60))]
            y = list(x)
            for _ in range(rng.randrange(3)):
                y[rng.randrange(len(y))] = rng.choice(letters)
            xs.append("".join(x) + "\n"), ys.append("".join(y) + "\n")
        want = []
        for x, y in zip(xs, ys, strict=True):
            p, q = line_dedup.shingle_set(x), line_dedup.shingle_set(y)
            want.append(5 * len(p & q) >= 4 * len(p | q))
        assert same(xs, ys).tolist() == same.exactly(xs, ys).tolist() == want


def groups_by_brute_force(rows, k, t):
    sets = []
    for r in rows:
        w = split(lower(r.text))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= t * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r.doc_id)
    least = {g: min((x for x in v if x is not None), default=None) for g, v in ids.items()}
    return [(r.doc_id, len(sets[i]), least[find(i)]) for i, r in enumerate(rows)], [find(i) == i for i in range(len(rows))], sets


@pytest.mark.parametrize(("k", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_jaccard_join(docs, empty, k, t):
    rows = numbered_rows(docs)
    want, first, sets = groups_by_brute_force(rows, k, t)
    out = jaccard_join.similar_groups(docs, k, t).collect()
    assert sorted(map(repr, ((r.id, r.n_shingles, r.component_id) for r in out))) == sorted(map(repr, want))
    kept = [r.doc_id for r in jaccard_join.drop_similar(docs, k, t).collect()]
    assert sorted(map(repr, kept)) == sorted(repr(r.doc_id) for r, f, s in zip(rows, first, sets, strict=True) if f)
    assert len(kept) < len(rows) - 20
    assert jaccard_join.similar_groups(empty, k, t).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = {x: x for e in edges for x in e}
    for _ in range(500):
        for a, b in edges:
            m = min(root[a], root[b])
            root[a] = root[b] = m
    got = {r.node: r.root for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k in got} and all(k in got or v == k for k, v in root.items())


def test_decontaminate(spark, docs, empty):
    rng = random.Random(8)
    items = [(i, " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(rng.randrange(3, 8))) for _ in range(rng.choice([7, 15, 30, 45])))) for i in range(25)]

    def edited(text, d):
        words = text.split()
        for _ in range(d):
            at, how = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + 1] = {0: [], 1: ["new", words[at]], 2: ["other"]}[how]
        return " ".join(words)

    rows, want = [], set()
    for i, text in items:
        n = len(text.split())
        for share in (0, 0.07, 0.14, 0.2):
            rows.append((len(rows), prose(rng, 50) + " " + edited(text, int(n * share)) + ".\n" + prose(rng, 30)))
            want.add((rows[-1][0], i))
    clean = [(1000 + i, prose(rng, 200)) for i in range(30)] + [(2000, None), (2001, "")]
    table = spark.createDataFrame(rows + clean, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (99, None), (98, "  ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(table, bench).collect()}
    assert set(got) <= want and len(got) >= 0.95 * len(want)
    assert all(got[4 * i, i] == 0 for i, _ in items)
    in_blocks = decontaminate.find_leaks(table, bench, block_items=7).collect()
    assert {(r.doc_id, r.item_id) for r in in_blocks} == set(got)
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(table, bench.limit(0)).count() == 0


def test_decontaminate_against_every_alignment(spark):
    rng = random.Random(31)
    vocabulary, law = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randrange(2, 8))) for _ in range(300)], [1 / (k + 3) for k in range(300)]
    words = lambda n: rng.choices(vocabulary, law, k=n)
    items = [words(rng.choice([16, 24, 40, 60])) for _ in range(30)]
    texts = [words(rng.randrange(20, 150)) for _ in range(60)]
    for item in items:
        for share in (0.05, 0.15, 0.2):
            part = list(item)
            for _ in range(int(share * len(item))):
                at, how = rng.randrange(len(part)), rng.randrange(3)
                part[at : at + 1] = {0: [], 1: [rng.choice(vocabulary), part[at]], 2: [rng.choice(vocabulary)]}[how]
            texts.append(words(20) + part + words(rng.randrange(20)))
    texts += [texts[-1], [], words(30_000) + items[0] + words(100)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    number = {w: k + 1 for k, w in enumerate(vocabulary)}
    coded = lambda t: np.array([number[w] for w in t], np.uint64)
    want = {(i, k): e for i, t in enumerate(texts) for k, item in enumerate(items) if (e := decontaminate.stretch_distance(coded(item), coded(t))) <= int(0.2 * len(item) + 1e-9)}
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash"))
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(table, bench).collect()}
    assert set(got) <= set(want) and len(want) > 90
    assert len(got) >= 0.95 * len(want) and sum(got[k] == want[k] for k in got) >= 0.95 * len(got)
    assert (len(texts) - 1, 0) in got


def test_unrelated_windows_are_rejected():
    rng = np.random.default_rng(4)
    words = lambda n: rng.integers(1, 1 << 40, n).astype(np.uint64)
    texts = [" ".join(map(str, words(n))) for n in (16, 30, 45, 60)]
    options = inspect.signature(decontaminate.find_leaks).parameters
    items = decontaminate.Items(texts, 0.2, *(options[k].default for k in ("walks", "tables", "bits", "seed")))
    for i, most in enumerate((0.35, 0.1, 0.05, 0.05)):
        n, flat, runs = int(items.n[i]), words(70_000), words(70_000)
        start = np.arange(0, 1000 * 65, 65)
        for s in start:
            at = int(rng.integers(0, n - 4))
            runs[s + at : s + at + 4] = items.words[i][at : at + 4]
        of = np.full(len(start), i)
        assert items.agree(flat, start, start + 65, of).mean() <= 0.01
        assert items.agree(runs, start, start + 65, of).mean() <= most  # one shared run alone
        flat[:n] = items.words[i]
        assert items.agree(flat, start[:1], start[:1] + n, of[:1]).all() and not items.agree(flat, start[:1], start[:1] + 2, of[:1]).any()


def test_pieces_of_few_words(spark):
    for m in range(5):
        words, row = np.arange(1, m + 1, dtype=np.uint64), np.zeros(m, np.int64)
        for k in range(1, 8):
            assert len(shingle_hashes(words, row, 1, k)[0]) == max(m - k + 1, min(m, 1))
            assert len(shingle_hashes(words, row, 1, k, short_whole=False)[0]) == max(m - k + 1, 0)
    leak = " ".join(f"w{i}" for i in range(20))
    table = spark.createDataFrame([(1, "two words"), (2, "just three words"), (3, leak)], "doc_id long, text string").repartitionByRange(3, "doc_id")
    bench = spark.createDataFrame([(7, leak)], "item_id long, text string")
    assert [tuple(r)[:3] for r in decontaminate.find_leaks(table, bench).collect()] == [(3, 7, 0)]
    assert sorted(r.doc_id for r in jaccard_join.drop_similar(table, 5, Fraction(4, 5)).collect()) == [1, 2, 3]


def test_stretch_distance():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(1, 7))] for _ in range(2))

        def plain(x, y):
            d = list(range(len(y) + 1))
            for i, p in enumerate(x, 1):
                prev, d[0] = d[0], i
                for j, q in enumerate(y, 1):
                    prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (p != q))
            return d[-1]

        want = min(plain(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert decontaminate.stretch_distance(np.array(a, np.uint64), np.array(b, np.uint64)) == want


def test_fit_is_exact_where_it_can_be():
    rng = random.Random(6)
    for _ in range(60):
        lengths = rng.sample(range(1, 30), rng.randrange(1, 6))
        counts = [rng.randrange(1, 5) for _ in lengths]
        budget = rng.randrange(0, 80)
        reach = {0}
        for n, c in zip(lengths, counts, strict=True):
            reach = {r + n * k for r in reach for k in range(c + 1)}
        best = max(r for r in reach if r <= budget)
        for knapsack in (1 << 16, 10_000):
            take = token_mix.fit(lengths, counts, budget, knapsack)
            assert all(0 <= k <= c for k, c in zip(take, counts, strict=True))
            assert sum(n * k for n, k in zip(lengths, take, strict=True)) == best
    assert sum(token_mix.fit(list(range(1, 400)), [1000] * 399, 7_654_321, 2000)[i] * (i + 1) for i in range(399)) == 7_654_321
    assert token_mix.water_fill([10, 10, 100], [1, 2, 3], 120, 3) == [22.5, 30.0, 67.5]


def test_token_mix(docs, empty):
    rows = docs.collect()
    run = lambda: token_mix.mix_sources(docs.withColumn("size", F.lit("clash"))).collect()
    out = run()
    assert sorted(map(repr, out)) == sorted(map(repr, run()))
    assert sorted(repr((r.doc_id, r.source, r.size)) for r in out) == sorted(repr((r.doc_id, r.source, len(split(r.text)))) for r in rows)
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
    assert abs(sum(v[0].target for v in by.values()) - sum(r.size for r in out)) < 1e-6
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v)
        assert abs(sum(r.taken for r in v) - v[0].target) <= 3
        assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in v)
    assert token_mix.mix_sources(empty).count() == 0


def test_language_id(spark, empty):
    rng = random.Random(9)
    kinds = {"aa": "lo mi ta re su ne", "bb": "krz pft wsz dzi cho"}

    def text(lang):
        return " ".join("".join(rng.choice(kinds[lang].split()) for _ in range(3)) for _ in range(60))

    rows = [(i, text(x := rng.choice("ab") * 2), x) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !!", "aa"), (902, "", None), (None, text("aa"), None)], "doc_id long, text string, lang string")
    books = language_id.learned_from(docs)
    assert list(books) == ["aa", "bb"]
    out = {r.doc_id: r for r in language_id.identify(docs.withColumn("score", F.lit("clash")), books).collect()}
    assert sum(out[i].lang_pred == x for i, _, x in rows) >= 398
    assert all((out[k].lang_pred, out[k].score, out[k].rejected) == ("und", 0.0, True) for k in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in out.values())
    assert language_id.identify(empty, books).count() == 0
    assert language_id.identify(docs.limit(3), {}).where("lang_pred = 'und'").count() == 3


def test_quality_rules(docs, empty):
    out = {repr((r.doc_id, r.n_words, r.word_chars)): r for r in quality_rules.judge_quality(docs).collect()}
    for r in docs.collect():
        w = split(r.text)
        grams = defaultdict(list)
        for i in range(len(w) - 2):
            grams[tuple(w[i : i + 3])].append(i)
        covered = {i + d for v in grams.values() if len(v) > 1 for i in v for d in range(3)}
        lines = [x for x in (r.text or "").split("\n") if split(x)]
        got = out[repr((r.doc_id, len(w), sum(map(len, w))))]
        assert (got.n_repeat_words, got.n_dup_lines, got.n_symbols) == (len(covered), len(lines) - len(set(lines)), sum(c in "#*$%&|<>" for c in r.text or ""))
        assert got.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (got.base_failed and got.kept)
    assert quality_rules.judge_quality(empty).count() == 0


def test_sketch_buckets(spark):
    df = spark.range(0, 5000).withColumn("b", quality_rules.bucket(F.col("id"))).withColumn("top", F.expr(quality_rules.bucket_top("b")))
    ends = df.groupBy("b", "top").agg(F.max("id").alias("m"), F.min("id").alias("lo")).where("m < 4000").collect()
    assert all(r.m == r.top and r.top - r.lo <= r.lo / 16 + 1 for r in ends)


def test_url_rules(spark, empty):
    urls = ["http://A.Example.com/en/7?x", "https://com/en/", "x://evil.net/de/1#f", "ftp://a.example.net/de/8", "no scheme", None, "http://example.org", "http://org/es/", "http://xcom.other/en/", "http://a.com/EN/", "http:///en/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, url_rules.rules_table(spark, url_rules.CONTRACT_RULES)).collect()}
    assert got[0] == got[11] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1] == ("com", "/en/", "com/en/", "block")
    assert got[2][2:] == ("net/de/", "allow") and got[3][2:] == ("example.net/de/8", "block")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert [got[i][2] for i in (6, 7, 8, 9, 10)] == [None, "org/es/", None, None, None]
    assert len(got) == 12


def test_licence_scan(spark, docs, empty):
    model = licence_scan.learned_from(docs)
    texts = ["Intro.\nReleased under the MIT License.\nlicensed under the apache license, version 2.0", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "All rights reserved.", None, "", prose(random.Random(1), 100)]
    found = licence_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in found) == [(0, 1, "mit"), (0, 2, "apache"), (1, 0, "gpl"), (2, 0, "cc_by_nc"), (3, 0, "unknown")]
    assert licence_scan.scan(docs, model).count() == 0
    assert licence_scan.scan(empty, model).count() == 0


def test_licence_scan_of_other_wordings(spark):
    rng = random.Random(12)
    model = licence_scan.train([prose(rng, 12) for _ in range(300)])
    want = {"The MIT licence applies to this work.": "mit", "SPDX-License-Identifier: Apache-2.0": "apache", "Licensed under the Eclipse Public License 2.0": "unknown", "available under EUPL 1.2": "unknown"}
    texts = [*want, "The general public may visit the apache village.", "word " * 50_000 + "\nAll rights reserved.", "All rights reserved.\n\nAll rights reserved."]
    table = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string").withColumn("paragraph", F.lit("clash"))
    found = licence_scan.scan(table, model).collect()
    clean = [(r.doc_id, r.paragraph, r.family) for r in found]
    assert sorted(clean) == sorted([(0, 0, "mit"), *((i, 0, f) for i, f in enumerate(want.values())), (5, 1, "unknown"), (6, 0, "unknown"), (6, 2, "unknown")])
    assert np.argmax(model.bias) == 0


def test_licence_scores_equal_a_plain_model(spark):
    rng = random.Random(13)
    model = licence_scan.train([prose(rng, 12) for _ in range(200)])
    texts = [s for v in licence_scan.STATEMENTS.values() for s in v] + [s for v in licence_scan.HELD_OUT.values() for s in v] + licence_scan.OTHER_SENSE
    at, weight = {f: i for i, f in enumerate(model.features)}, licence_scan.word_weights()
    want = {}
    for i, s in enumerate(texts):
        words = licence_scan.tokens(s)
        z = (model.bias + sum((model.weights[at[g]] for g in licence_scan.grams(words) if g in at), 0.0)) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        c = licence_scan.CLASSES[int(np.argmax(z))]
        if c == "none" or p[0] > 0.1:
            continue
        share = max(sum(weight[w] for w in set(licence_scan.tokens(t)) & set(words)) / sum(weight[w] for w in set(licence_scan.tokens(t))) for t in licence_scan.STATEMENTS[c])
        want[i] = (c if p.max() >= 0.5 and share >= 0.6 else "unknown", round(float(p.max()), 4))
    found = licence_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert {r.doc_id: (r.family, round(r.probability, 4)) for r in found} == want


def test_licence_scan_after_sampling_the_statements_words(spark):
    plain = ["The public was let in by the east door.", "This domain of science is old.", "He has all his rights.", "Seats are reserved for guests.", "A new version was released in May."]
    model = licence_scan.train(plain * 20 + ["ta lo mi"] * 50)
    texts = ["This work is in the public domain.", "All rights reserved.", *plain]
    found = licence_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id, r.family) for r in found) == [(0, "public_domain"), (1, "unknown")]


def test_site_quality(spark, docs, empty):
    rng = random.Random(3)
    rows = [(i, prose(rng, 120) if i % 3 else "### $$$ " * 40, "en", f"s{i % 4}", 0) for i in range(240)]
    table = spark.createDataFrame([*rows, (900, None, None, None, 0)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 240, 2)] + [(None, 1)], "doc_id long, quality int")
    out = {r.doc_id: r for r in site_quality.judge_sites(table, labels).collect()}
    assert len(out) == 241 and all(out[i].kept == bool(i % 3) for i in range(240))
    assert all(0 < r.path_rate < 1 and 0 <= r.score <= 1 for r in out.values())
    assert site_quality.judge_sites(empty, labels).count() == 0
    assert site_quality.judge_sites(docs, labels.limit(0)).count() == docs.count()


def test_sparse_sites_stay_near_the_global_rate(spark):
    rng = random.Random(14)
    same = prose(rng, 100)
    docs = spark.createDataFrame([(i, same, "en", f"s{i}", 0) for i in range(400)], SCHEMA)
    labels = spark.createDataFrame([(i, rng.randrange(2)) for i in range(400)], "doc_id long, quality int")
    rows = site_quality.judge_sites(docs, labels).collect()
    assert all(abs(r.site_rate - 0.5) < 0.08 and abs(r.score - 0.5) < 0.12 for r in rows)
    two = spark.createDataFrame([(i, same, "en", "good" if i < 200 else "bad", 0) for i in range(400)], SCHEMA)
    labels = spark.createDataFrame([(i, int(rng.random() < (0.9 if i < 200 else 0.1))) for i in range(400)] + [(0, 1)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in site_quality.judge_sites(two.withColumn("score", F.lit("clash")), labels).collect()}
    assert all(r.site_rate > 0.8 and r.kept if i < 200 else r.site_rate < 0.2 and not r.kept for i, r in rows.items())


def test_site_strength_recovers_the_prior():
    rng = np.random.default_rng(3)
    for true in (2.0, 20.0):
        n = rng.integers(1, 60, 3000)
        k = rng.binomial(n, rng.beta(0.4 * true, 0.6 * true, 3000))
        total, mu = int(n.sum()), k.sum() / n.sum()
        got = site_quality.strength(mu, float(k.sum()), k.sum() ** 2 / total, float((k**2 / n).sum()), total, 1, 3000, total - float((n**2).sum()) / total)
        assert 0.8 * true < got < 1.25 * true


def test_site_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("quality IS NOT NULL")
    train, rest = known.where("doc_id % 2 = 0"), {r.doc_id: r.quality for r in known.where("doc_id % 2 = 1").collect()}
    kept = {r.doc_id: r.kept for r in site_quality.judge_sites(docs, train).collect()}
    assert sum(kept[i] == bool(q) for i, q in rest.items()) >= 0.9 * len(rest) > 90


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    slim = docs.select("doc_id", "text", "lang", language_id.held_out(F.col("doc_id")).alias("held"))
    rows = language_id.identify(slim, language_id.learned_from(docs)).where("held AND lang IS NOT NULL AND length(text) > 100").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows) > 100


def test_language_id_of_ties_copies_and_long_texts(spark):
    same = {"aa": b"lo mi ta re su ne " * 50, "bb": b"lo mi ta re su ne " * 50}
    table = spark.createDataFrame([(1, "lo mi ta re"), (1, "lo mi ta re"), (2, "lo mi ta " * 100_000)], "doc_id long, text string")
    rows = language_id.identify(table, same).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in rows} == {("aa", 0.0, True)} and len(rows) == 3
    copies = spark.createDataFrame([(i, "krz pft wsz dzi cho", "bb") for i in range(3000)] + [(5000 + i, f"lo mi ta re su {i}", "aa") for i in range(50)], "doc_id long, text string, lang string")
    assert set(language_id.learn(copies)) == {"aa", "bb"}


def test_stages(spark, tmp_path, corpus):
    import corpus_pipeline

    rng = random.Random(11)
    leak = " ".join("w" + str(rng.randrange(9999)) for _ in range(25))
    spark.createDataFrame([*corpus, (5000, prose(rng, 40) + " " + leak, "en", "s1", 0)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, str(tmp_path)))
        assert out.columns == corpus_pipeline.COLUMNS, name
        assert out.count() <= docs.count()
        if name == "decontaminate":
            assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in out.collect()} == {5000}
        docs = out
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert mixed.count() == docs.count()
