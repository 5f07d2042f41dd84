"""N-gram join, substring dedup, decontamination, against brute force."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np

from wayfold.llm import decontaminate, setjoin, similar, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, sig string, comp string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", "x", "x") for d, t in rows], DOCS)


def corpus(seed=1, bases=14, copies=9):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for b in range(bases):
        words = rng.choices(vocab, k=rng.choice([3, 8, 12, 15, 19, 22, 30, 60, 150, 400]))
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            if rng.random() < 0.3:
                own.insert(rng.randrange(len(own)), rng.choice(vocab))
            rows.append((n, " ".join(own)))
            n += 1
    rng.shuffle(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One two"), (n + 4, "one TWO"), (n + 5, "one"), (None, "one two"), (0, rows[0][1])]


def shingle_set(text, size=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_components(rows, percent=90):
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(x & y) >= percent * len(x | y):
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    return sorted((str(d), len(s), str(root(d)) if d is not None else "None") for d, s in sets)


def test_ngram_join_is_exact(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        rows = [(100_000 if k == len(rows) - 1 else d, t) for k, (d, t) in enumerate(rows)]
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in setjoin.ngram_join(frame(spark, rows)).collect())
        assert got == brute_components(rows)
    assert setjoin.ngram_join(frame(spark, rows).limit(0)).count() == 0


def test_ngram_join_in_blocks(spark, monkeypatch):
    """With blocks of three members, what hubs leave open is found by pairs of blocks."""
    monkeypatch.setattr(similar, "BLOCK", 3)
    rows = corpus(5, bases=4, copies=30)[:-1]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in setjoin.ngram_join(frame(spark, rows)).collect())
    assert got == brute_components(rows)


def test_block_pairs_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 4)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = [np.unique(np.r_[base[rng.random(200) > 0.03], rng.integers(0, 1 << 62, 4).astype(np.uint64)]) for _ in range(30)]
    left = spark.createDataFrame([(7, k, k, len(s), similar.parity(s).tobytes()) for k, s in enumerate(sets)], "sig long, h long, comp long, n int, p binary")
    got = {(r.a, r.b) for r in similar._block_pairs(left, 90).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(30), 2) if similar.alike(sets[a], sets[b], 90)}
    assert want and want <= got


def near_ones(rng, many, size=300):
    """Sets near one base and just about as near to each other as links need."""
    base = rng.integers(0, 1 << 62, size).astype(np.uint64)
    return [np.unique(np.r_[base[rng.random(size) > rng.choice([0.01, 0.025, 0.028])], rng.integers(0, 1 << 62, 8).astype(np.uint64)]) for _ in range(many)]


def rooted(many, edges):
    root = [*range(many)]
    for a, b in edges:
        root = [root[a] if r == root[b] else r for r in root]
    return {frozenset(k for k in range(many) if root[k] == r) for r in root}


def test_blocks_give_no_more_rows_than_members(spark, monkeypatch):
    """A group of near ones has pairs by the square; a block gives a forest over them, and the exact sets meet once."""
    sets = near_ones(np.random.default_rng(8), 60)
    listed = [(7, k, k, len(s), similar.parity(s).tobytes()) for k, s in enumerate(sets)]
    left = spark.createDataFrame(listed, "sig long, h long, comp long, n int, p binary")
    every = {(r.a, r.b) for r in similar._block_pairs(left, 90).collect()}
    forest = [(r.a, r.b) for r in similar._block_pairs(left, 90, forest=True).collect()]
    assert len(every) > 5 * 60 and len(forest) < 60 and set(forest) <= every and rooted(60, forest) == rooted(60, every)
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if similar.alike(sets[a], sets[b], 90)}
    assert 20 < len(want) < len(every)
    for size in (512, 7):
        monkeypatch.setattr(similar, "BLOCK", size)
        for comps in ([*range(60)], [k // 3 for k in range(60)]):
            rows = spark.createDataFrame([(5, k, comps[k], s.tobytes()) for k, s in enumerate(sets)], "cluster long, h long, comp long, s binary")
            got = [(r.a, r.b) for r in similar.block_links(rows, 90).collect()]
            known = [(a, b) for a, b in itertools.combinations(range(60), 2) if comps[a] == comps[b]]
            assert set(got) <= want and rooted(60, [*known, *got]) == rooted(60, [*known, *want])
            assert size == 7 or len(got) < 60


def test_groups_of_near_ones_are_exact(spark):
    """Sets of several sizes; what hubs leave open is decided by clusters."""
    sets = [s for k, size in enumerate((150, 300, 2500)) for s in near_ones(np.random.default_rng(20 + k), 25, size)]
    table = spark.createDataFrame([(k, len(s), similar.parity(s).tobytes(), similar.wide_parity(s).tobytes()) for k, s in enumerate(sets)], "h long, n int, p binary, w binary")
    stored = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(sets)], "h long, s binary")
    links = [(a, b) for a, b in itertools.combinations(range(75), 2) if similar.alike(sets[a], sets[b], 90)]
    want = {g for g in rooted(75, links) if len(g) > 1}
    for sketches in (table, None):
        got = {}
        for r in similar.components(spark.createDataFrame([(7, k) for k in range(75)], "sig long, h long"), lambda x: stored.join(x.distinct(), "h"), 90, sketches).collect():
            got.setdefault(r.comp, set()).add(r.h)
        assert {frozenset(g) for g in got.values()} == want


def test_signatures_are_shared_by_linked_sets():
    rng = np.random.default_rng(3)
    scheme = setjoin.Scheme(90)
    assert scheme.light >= 10
    for n in [5, 10, 13, 19, 20, 21, 22, 25, 40, 90, 91, 300, 1000]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            lose = int(rng.integers(0, n // 10 + 1))
            add = int(rng.integers(0, n // 10 + 1))
            b = np.unique(np.r_[rng.permutation(a)[: len(a) - lose], rng.integers(0, 1 << 62, add).astype(np.uint64)])
            if similar.alike(a, b, 90) and not np.array_equal(a, b):
                assert np.intersect1d(scheme.signatures(a), scheme.signatures(b)).size, (n, lose, add)


def test_signatures_are_shared_at_the_stage_parameters():
    rng = np.random.default_rng(4)
    scheme, met = setjoin.Scheme(80), 0
    for n in [2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 20, 26, 40, 90, 300, 1000]:
        for k in range(60):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            lose = int(rng.integers(0, n // 5 + 1)) if k % 3 else 0
            add = int(rng.integers(0, n // 4 + 1)) if k % 3 != 1 else 0
            b = np.unique(np.r_[rng.permutation(a)[: len(a) - lose], rng.integers(0, 1 << 62, add).astype(np.uint64)])
            if similar.alike(a, b, 80) and not np.array_equal(a, b):
                met += 1
                assert np.intersect1d(scheme.signatures(a), scheme.signatures(b)).size, (n, lose, add)
    assert met > 200


def test_ngram_join_is_exact_at_the_stage_parameters(spark):
    rows = [r for r in corpus(6, bases=10)[:-1] if r[0] is not None]
    sets = [(d, shingle_set(t, 5)) for d, t in rows]
    linked = {(a, b) for (a, x), (b, y) in itertools.permutations(sets, 2) if x and y and 100 * len(x & y) >= 80 * len(x | y)}
    want = {d: d for d, _ in rows}
    for _ in rows:
        for a, b in linked:
            want[a] = min(want[a], want[b])
    assert {r.doc_id: r.component_id for r in setjoin.ngram_join(frame(spark, rows), 80, 5).collect()} == want


def test_keep_one_takes_five_words_and_four_fifths(spark):
    """With four of 200 words changed, two texts are 0.8 alike in shingles of five words, and less than 0.9 in those of three."""
    words = [f"s{k}" for k in range(200)]
    near = [*words]
    for k in (20, 70, 120, 170):
        near[k] = "other"
    assert not similar_at(words, near, 3, 90) and similar_at(words, near, 5, 80)
    kept = setjoin.keep_one_of_each_group(spark, frame(spark, [(1, " ".join(words)), (2, " ".join(near))]), "").collect()
    assert [r.doc_id for r in kept] == [1]


def similar_at(a, b, size, percent):
    x, y = shingle_set(" ".join(a), size), shingle_set(" ".join(b), size)
    return 100 * len(x & y) >= percent * len(x | y)


def test_large_sets_are_made_only_for_pairs_that_can_be_alike(spark):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (3000, 3100, 3200, 3300, 6000, 6300, 400, 20000)]
    sets.append(np.unique(np.r_[sets[0][:-60], sets[1][:60]]))  # linked with the first
    sets.append(np.unique(np.r_[sets[4][:-900], sets[5][:900]]))  # not linked, but of one size
    table = spark.createDataFrame([(k, len(s), similar.parity(s).tobytes(), similar.wide_parity(s).tobytes()) for k, s in enumerate(sets)], "h long, n int, p binary, w binary")
    made = []

    def sets_of(wanted):
        made.extend(r.h for r in wanted.distinct().collect())
        return spark.createDataFrame([(h, sets[h].tobytes()) for h in made], "h long, s binary").join(wanted.distinct(), "h")

    for percent in (90, 80):
        made.clear()
        got = similar.components(spark.createDataFrame([(7, k) for k in range(len(sets))], "sig long, h long"), sets_of, percent, table)
        assert {tuple(r) for r in got.collect()} == {(0, 0), (8, 0)}
        assert set(made) == {0, 8}
        listed = table.selectExpr("7L AS sig", "h", "h AS comp", "n", "p", "w")
        assert {tuple(r) for r in similar._block_pairs(listed, percent).collect()} == {(0, 8)}


def test_wide_sketches_fold_and_lose_no_link():
    rng = np.random.default_rng(6)
    for n in (900, 3000, 9000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        wide = similar.wide_parity(a)
        assert (similar.folded(wide, similar.PARITY_WORDS) == similar.parity(a)).all()
        b = np.unique(np.r_[a[n // 40 :], rng.integers(0, 2**63, n // 40).astype(np.uint64)])
        other = similar.wide_parity(b)
        words = min(len(wide), len(other))
        assert np.bitwise_count(similar.folded(wide, words) ^ similar.folded(other, words)).sum() <= len(np.setxor1d(a, b))


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = {r.h: r.comp for r in similar.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_keep_one_of_each_group(spark):
    rows = [(5, "a b c d e"), (2, "a b c d e"), (9, "q r s"), (9, "q r s"), (11, None), (12, None)]
    kept = setjoin.keep_one_of_each_group(spark, frame(spark, rows), "").collect()
    assert sorted(r.doc_id for r in kept) == [2, 9, 11, 12]


def test_keep_one_decides_by_row(spark):
    """Rows without a doc_id and rows of one doc_id with different texts go only if their own text is linked."""
    rows = [(None, "only here a b c"), (None, "u v w x y z"), (None, "u v w x y z"), (None, ""), (None, ""), (3, "g h i j k l"), (3, "m n o p q r"), (1, "m n o p q r"), (None, "g h i j k l"), (4, None), (4, None)]
    kept = setjoin.keep_one_of_each_group(spark, frame(spark, rows), "").collect()
    want = [(None, "only here a b c"), (None, "u v w x y z"), (None, ""), (None, ""), (3, "g h i j k l"), (1, "m n o p q r"), (4, None), (4, None)]
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(d), str(t)) for d, t in want)


def passages(seed=0, n=6):
    rng = random.Random(seed)
    return [" ".join(f"p{rng.randrange(5000)}" for _ in range(60)) for _ in range(n)]


def pieces_of(text, near=8, size=5):
    """(first word, words) of the pieces of a text, one word at a time."""
    out, at = [], 0
    for line in text.split("\n"):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in line)) if w]
        m = [hashlib.md5(w.encode()).hexdigest()[:16] for w in words]
        start = 0
        for i in range(len(words)):
            inside = near <= i < len(words) - near and m[i] < min(m[i - near : i]) and m[i] <= min(m[i + 1 : i + near + 1])
            if inside or i == len(words) - 1:
                if i + 1 - start >= size:
                    out.append((at + start, i + 1 - start, frozenset(tuple(words[k : k + size]) for k in range(start, i + 2 - size))))
                start = i + 1
        at += len(words)
    return out


def brute_paragraphs(rows, least=30):
    pieces = [(d, k, *p) for d, t in rows if d is not None for k, p in enumerate(pieces_of(t or ""))]
    parent = list(range(len(pieces)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = set()
    for a, b in itertools.combinations(range(len(pieces)), 2):
        x, y = pieces[a][4], pieces[b][4]
        if 100 * len(x & y) >= 80 * len(x | y):
            linked |= {a, b}
            parent[max(root(a), root(b), key=lambda k: pieces[k][:2])] = min(root(a), root(b), key=lambda k: pieces[k][:2])
    out, run = set(), []
    for k in sorted(linked, key=lambda k: pieces[k][:2]) + [None]:
        if run and (k is None or pieces[k][:2] != (pieces[run[-1]][0], pieces[run[-1]][1] + 1)):
            size = pieces[run[-1]][2] + pieces[run[-1]][3] - pieces[run[0]][2]
            if size >= least:
                out |= {(*pieces[r][:4], size, *pieces[root(r)][:2], root(r) == r) for r in run}
            run = []
        run.append(k)
    return out


def test_repeated_paragraphs(spark):
    """Against brute force: copies inside lines, whole lines, edits, repeats within a document, short stock lines."""
    rng = random.Random(31)
    p, own = passages(n=8), iter(passages(9, 160))
    rows = [(6, None), (7, ""), (None, p[0]), (9, "\n\n" + "ab " * 9000), (8, f"{p[2]}\n{next(own)}\n{p[2]}")]
    for d in range(10, 40):
        words = p[rng.randrange(8)].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(60)] = "changed"
        cut = " ".join(words[rng.choice([0, 0, 5]) :])
        rows.append((d, rng.choice([f"{next(own)} {cut.upper()} {next(own)}", f"{next(own)}\n{cut}\nshort stock line of words", f"{cut}"])))
    got = {tuple(r) for r in substring.repeated_paragraphs(frame(spark, rows)).collect()}
    want = brute_paragraphs(rows)
    assert got == want and len({r[0] for r in want}) > 15
    assert substring.repeated_paragraphs(frame(spark, rows).limit(0)).count() == 0
    low = {tuple(r) for r in substring.repeated_paragraphs(frame(spark, rows), least_words=5).collect()}
    assert low == brute_paragraphs(rows, 5) and any(r[3] == 5 for r in low)


def test_a_passage_in_mid_line_is_found(spark):
    rng = random.Random(5)
    own = lambda n: " ".join(f"o{rng.randrange(100_000)}" for _ in range(n))
    all_, rows = set(), []
    for k in range(60):
        passage = own(75)
        rows += [(2 * k, f"{own(70)} {passage} {own(90)}"), (2 * k + 1, f"{own(33)} {passage}, {own(20)}")]
        all_ |= {2 * k, 2 * k + 1}
    rows += [(500 + k, own(200)) for k in range(20)]
    found = {r.doc_id for r in substring.repeated_paragraphs(frame(spark, rows)).collect()}
    assert len(found & all_) >= 0.95 * len(all_) and not found - all_


def test_cut_repeats(spark):
    p, own = passages(), passages(9, 8)
    rows = [(1, f"{own[0]}\n{p[0]}"), (2, f"{p[0]}\n{own[1]}"), (3, p[0]), (4, "clean words"), (5, None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in substring.cut_repeats(spark, frame(spark, rows), "").collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: (own[1], len(own[1])), 4: ("clean words", 11), 5: (None, 0)}


def test_passages_inside_lines_are_cut(spark):
    """A passage of 60 words within otherwise different lines, and one wrapped anew, stay once; a shorter one stays."""
    rng = random.Random(7)
    own = lambda n: " ".join(f"o{rng.randrange(100_000)}" for _ in range(n))
    p, (a, b, c, d, e, f) = passages(3, 2), (own(80) for _ in range(6))
    words, short = p[1].split(), own(49)
    wrapped = "\n".join(" ".join(words[k : k + 9]) for k in range(0, 60, 9))
    rows = [(1, f"{a} {p[0]} {b}"), (2, f"{c} {p[0].upper()} {d}"), (3, p[1]), (4, f"{e}\n{wrapped}\n{f}"), (5, f"{own(70)} {short} {own(70)}"), (6, f"{own(70)} {short} {own(70)}"), (7, "la " * 500)]
    got = {r.doc_id: r.text for r in substring.cut_repeats(spark, frame(spark, rows), "").collect()}
    want = dict(rows) | {2: f"{c} {d}", 4: f"{e}\n\n{f}"}
    assert got.pop(7).startswith("la " * 49 + "la") and want.pop(7)
    assert got == want


def test_short_lines_are_cut(spark):
    """Lines of five words or more count, equal or alike; those of four stay."""
    long = " ".join(f"k{x}" for x in range(24))
    rows = [(1, "one\nall rights are reserved here"), (2, "All rights are RESERVED here\ntwo"), (3, f"{long}\nthree"), (4, f"four\n{long} more"), (5, "one two three four\nfive"), (6, "one two three four\nsix")]
    got = {r.doc_id: r.text for r in substring.cut_repeats(spark, frame(spark, rows), "").collect()}
    assert got == dict(rows) | {2: "two", 4: "four"}


def test_every_repeated_run_is_found(spark):
    """Against all runs of 50 words, one by one."""
    rng = random.Random(12)
    bases = [[f"b{rng.randrange(9000)}" for _ in range(300)] for _ in range(4)]
    docs = []
    for k in range(30):
        words = [f"d{k}_{x}" for x in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(3)):
            base, at = rng.choice(bases), rng.randrange(200)
            words += base[at : at + rng.choice([49, 50, 51, 70, 100])] + [f"e{rng.randrange(10**6)}"]
        docs.append((k, " ".join(words)))
    where = {}
    for k, t in docs:
        w = t.split()
        for s in range(len(w) - 49):
            where.setdefault(tuple(w[s : s + 50]), []).append((k, s))
    gone, stay = set(), set()
    for places in where.values():
        if len(places) > 1:
            stay |= {(places[0][0], places[0][1] + x) for x in range(50)}
            gone |= {(k, s + x) for k, s in places[1:] for x in range(50)}
    got = {(r.doc_id, r.word + x) for r in substring.repeated_passages(frame(spark, docs)).collect() for x in range(r.words)}
    assert got == gone - stay and len(got) > 100


def test_bands_miss_no_link():
    rng = np.random.default_rng(6)
    for n in [1, 3, 4, 5, 9, 13, 20, 40]:
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            b = np.unique(np.r_[rng.permutation(a)[: len(a) - int(rng.integers(0, n // 5 + 1))], rng.integers(0, 1 << 62, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)])
            if similar.alike(a, b, 80) and not np.array_equal(a, b):
                p, q = (x[: int(substring.bands_of(np.array([len(x)]), 80)[0])] for x in (a, b))
                assert np.intersect1d(p, q).size


def test_contaminated(spark):
    rng = random.Random(8)
    items = [(k, " ".join(f"q{rng.randrange(900)}" for _ in range(rng.choice([3, 5, 12, 40, 60])))) for k in range(25)] + [(90, None), (91, ""), (None, "a b c d e f"), (92, "Same words, same words here!")]
    rows = []
    for d in range(120):
        words = [f"x{rng.randrange(3000)}" for _ in range(rng.choice([0, 3, 50, 800]))]
        if d % 2:
            w = (items[rng.randrange(25)][1]).split()
            cut = rng.choice([0, 0, 1, 2, 5])
            at = rng.randrange(len(words) + 1)
            words[at:at] = [x.upper() + "," for x in w[cut:]]
        rows.append((d, " ".join(words)))
    short = next(t for _, t in items[:25] if len(t.split()) == 3)
    rows += [(500, None), (501, items[0][1]), (None, items[3][1]), (502, "same words same words HERE"), (501, "other text"), (503, f"long {short} " + "text " * 40), (504, short)]
    got = {(r.doc_id, r.item_id): (r.shared, r.item_shingles) for r in decontaminate.contaminated(frame(spark, rows), spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, sh string")).collect()}

    def sh(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    def held(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[k : k + n]) for n in range(1, 6) for k in range(len(w) - n + 1)}

    per = {}
    for d, t in rows:
        if d is not None:
            per.setdefault(d, set()).update(held(t))
    want = {}
    for d, s in per.items():
        for i, t in items:
            q = sh(t)
            if i is not None and q and len(q & s) >= np.ceil(0.8 * len(q) - 1e-9):
                want[d, i] = (len(q & s), len(q))
    assert got == want and len(want) > 20
    assert decontaminate.contaminated(frame(spark, rows).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_drop_contaminated_decides_by_row(spark, tmp_path):
    item = "one two three four five six seven"
    spark.createDataFrame([(1, item), (2, "four words in all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, f"x {item} y", "a"), (1, "clean text of the same id", "a"), (None, f"{item} z", "b"), (None, "clean", "b"), (2, None, "c"), (3, "there are FOUR words, in all of it", "c"), (4, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = decontaminate.drop_contaminated(spark, df, str(tmp_path))
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, df.where("text LIKE 'clean%' OR text IS NULL OR text = ''").collect()))


def test_sql_agrees_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for f, sql in ((setjoin.op9_ngram_join, setjoin.OP9_SQL), (substring.op8_substring_dedup, substring.OP8_SQL), (decontaminate.op5_decontaminate, decontaminate.OP5_SQL)):
        df = f(spark, sf)
        want = con.sql(sql)
        assert sorted(tuple(r[c] for c in want.columns) for r in df.collect()) == sorted(want.fetchall())


def test_pieces_in_one_pass_over_words():
    """Words are hashed where they are met first and never gone through before; pieces are those of a plain reading, also with more than 16 bits of them."""
    rng = random.Random(6)
    texts = ["", "\n \n", *("\n".join(" ".join(rng.choices(["Ride", "node", "x", "é", "street"], k=rng.randint(0, 60))) for _ in range(rng.randint(1, 5))) for _ in range(60))]
    known = substring.word_codes()
    known.entries = 3
    asked = []
    known.of = lambda w, of=known.of: asked.append(w) or of(w)
    p = substring.Pieces.of(texts, known, 5)
    assert sorted(asked) == sorted({w for t in texts for w in t.encode().lower().split()})
    at = 0
    for owner, word, words, size in zip(p.owner, p.word, p.words, p.sizes):
        own = texts[owner].encode().lower().split()[word : word + words]
        codes = np.array([int.from_bytes(hashlib.md5(w).digest()[:8], "big") for w in own], np.uint64)
        assert (p.shingles[at : at + size] == np.unique(substring.shingle_hashes(codes, 5))).all()
        at += size
    assert at == len(p.shingles)
    known.learn()
    assert not known  # it had grown past `entries`
    h, group = np.array(rng.choices(range(1 << 40), k=500), np.uint64), np.sort(np.array(rng.choices(range(70_000), k=500)))
    for g in (group, group[:100] % 7 * 0, group[:0]):
        assert (substring.in_order(h[: len(g)], g) == np.lexsort((h[: len(g)], g))).all()
