import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ampliq.functions import seq as S
from ampliq.functions.iupac import distance, equal_letters
from ampliq.operators import compare, consensus, identify, nearest, reads, records, runs
from ampliq.operators.counts import column_counts, count_matrix
from ampliq.operators.ordering import running
from ampliq.plans import phases

from .test_kernels import slow, word


def test_running_over_a_hot_key(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice("abc"), i, rnd.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {(r.k, r.i): (r.rn, r.s) for r in running(df, ["i"], keys=["k"], sums={"s": "v"}).collect()}
    n, total = Counter(), Counter()
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        n[k] += 1
        total[k] += v
        assert got[k, i] == (n[k], total[k])
    whole = {r.i: r.rn for r in running(df, [F.col("i").desc()]).collect()}
    assert whole == {i: 500 - i for i in range(500)}


@pytest.mark.parametrize("bases,most,blocks", [(10, None, 2), (25, 3, 1), (7, 2, 3)])
def test_split_bases(spark, bases, most, blocks):
    rnd = random.Random(bases)
    rows = [(rnd.choice(["x", "x", "y"]), i, "A" * rnd.choice([0, 1, 3, 5, 8, 40])) for i in range(150)]
    df = spark.createDataFrame([(r, i, f"h{i}", s) for r, i, s in rows], "run string, ord int, header string, seq string")
    want = {}
    for run in "xy":
        part, acc, count = 1, 0, 0
        for r, i, s in rows:
            if r != run:
                continue
            if count and (acc + len(s) > bases or (most and count >= most)):
                part, acc, count = part + 1, 0, 0
            acc, count = acc + len(s), count + 1
            want[i] = part
    assert {r.ord: r.part for r in records.split_bases(df, bases, most, blocks).collect()} == want


def brute_tags(tags, rounds):
    known = {t: (t, 0) for t in tags}
    front = dict.fromkeys(tags)
    front = {t: t for t in tags}
    for depth in range(1, rounds + 1):
        owners = defaultdict(set)
        for spelling, tag in front.items():
            n = len(spelling)
            made = set()
            for i in range(n):
                for b in "ACGT":
                    made.add(spelling[:i] + b + spelling[i + 1 :])
                    if i:
                        made.add(b + spelling[:i] + spelling[i + 1 :])
                        made.add(spelling[1:] + b if i == n - 1 else spelling[1:i] + b + spelling[i:])
            for m in made - {spelling}:
                if m not in known:
                    owners[m].add(tag)
        front = {m: next(iter(o)) for m, o in owners.items() if len(o) == 1}
        known |= {m: (t, depth) for m, t in front.items()}
    return known


def test_tag_variants(spark):
    sheet = spark.createDataFrame([("s1", "AACCTT", "TGCATC"), ("s2", "CAGTAC", "TGCATC"), ("s3", "AACCTA", "GGCAAT")], "sample string, tag_f string, tag_r string")
    got = {r.variant: (r.tag, r.depth) for r in reads.tag_variants(sheet, 2).collect()}
    assert got == brute_tags(["AACCTT", "TGCATC", "CAGTAC", "AACCTA", "GGCAAT"], 2)


def test_primers_with_errors_and_two_pairs(spark):
    p = reads.ReadParams(taglen=4, primers_f=("ACGTRACGTTGC", "TTTTGGGGCCCC"), primers_r=("GATTACAGATTA",), window=40, primermm=2)
    rc = lambda s: s.translate(str.maketrans("ACGTR", "TGCAY"))[::-1]
    insert = "CATCATTGGACCAATTGGCCATCATCATGGGACCCATTTGG"
    read = "GG" + "TTAA" + "ACGTAACGATGC" + insert + rc("GATTACAGATTA") + rc("CCGG") + "A"
    other = "TTAA" + "TTTTGGGGCCCC" + insert + rc("GATTACAGATTA") + rc("CCGG")
    short = "AA" + "ACGTAACGTTGC" + insert + rc("GATTACAGATTA") + rc("CCGG")
    df = spark.createDataFrame([("a", read), ("b", rc(read)), ("c", other), ("d", short), ("e", "ACGT")], "read_id string, seq string")
    got = {r.read_id: r for r in reads.locate_primers(df, p).collect()}
    assert set(got) == {"a", "b", "c"}
    for key, strand, d in (("a", "+", 1), ("b", "-", 1), ("c", "+", 0)):
        r = got[key]
        assert (r.tag_f, r.tag_r, r.insert, r.strand, r.primer_dist) == ("TTAA", "CCGG", insert, strand, d)


def test_compare_all_and_groups(spark):
    rnd, equal = random.Random(9), equal_letters("overlap")
    flip = str.maketrans("ACGTN", "TGCAN")
    rows = []
    for i in range(40):
        base = word(rnd, "ACGT", 40) + "ACCA"
        for run in (1, 2, 3):
            kind = rnd.randint(0, 4)
            seq = [base, base[:5] + "N" + base[6:], base.translate(flip)[::-1], base + "TT", "G" + base[1:]][kind]
            rows.append((run, run * 1000 + i, f"id{i}", seq))
    df = spark.createDataFrame([(*r, len(r[3]), 10, 0, 0) for r in rows], "run int, ord int, id string, seq string, length int, cov int, ambs int, gaps int")
    seqs = {(i, r): s for r, _, i, s in rows}
    for r in compare.compare_all(df).collect():
        x, y = sorted([seqs[r.id, r.run_a], seqs[r.id, r.run_b]])
        d, plain = slow(x, y, equal), slow(x, y, {})
        rc = x.translate(flip)[::-1]
        d2, plain2 = slow(rc, y, equal), slow(rc, y, {})
        if d == 0:
            want = ("compatible" if plain else "identical", 0, plain, False)
        elif d2 == 0:
            want = ("compatible" if plain2 else "identical", 0, plain2, True)
        else:
            want = ("different", d2, plain2, True) if d2 < d else ("different", d, plain, False)
        assert (r.state, r.d, r.plain, r.rc) == want
    report = {r.id: r for r in compare.compare_report(df, [1, 2, 3]).collect()}
    assert len(report) == 40 and all(len(r.pattern) == 3 for r in report.values())
    ends = compare.variant_groups(df, ignore_ends=True).groupBy("id").agg(F.max("variant").alias("n")).collect()
    assert all(r.n <= report[r.id].vars for r in ends)


def test_nearest_refs(spark):
    rnd, equal = random.Random(11), equal_letters("base")
    roots = [word(rnd, "ACGT", 20) + "".join(rnd.choice("ACGT") for _ in range(150)) for _ in range(6)]

    def near(s):
        s = list(s)
        for _ in range(rnd.randint(0, 8)):
            s[rnd.randrange(len(s))] = rnd.choice(["A", "C", "G", "T", "N", "", "AC"])
        return "".join(s)

    # One reference is mostly unknown: it alone is looked for by short words or by length.
    refs = list({near(rnd.choice(roots)) for _ in range(80)} | {"N" * 100 + roots[0][100:]})
    queries = [near(r) for r in roots] + ["ACGT" * 5, refs[0]]
    got = defaultdict(list)
    out = nearest.nearest_refs(
        spark.createDataFrame([(f"q{i}", s) for i, s in enumerate(queries)], "id string, seq string"),
        spark.createDataFrame([(f"r{i}", s) for i, s in enumerate(refs)], "name string, seq string"), 5,
    )
    for r in out.orderBy("id", "rn").collect():
        got[r.id].append((r.dist, r.name))
    for i, s in enumerate(queries):
        want = sorted((distance(s, r, equal), r, f"r{j}") for j, r in enumerate(refs) if r != s)[:5]
        assert got[f"q{i}"] == [(d, n) for d, _, n in want]


def test_unlike_refs_are_not_stored_in_pairs(spark, monkeypatch):
    """Queries unlike all references meet them as they pass; no step keeps a row for each pair."""
    rnd, equal = random.Random(12), equal_letters("base")
    refs = ["".join(rnd.choices("ACGT", k=rnd.randrange(40, 80))) for _ in range(150)] + ["A" * 30 + "N" * 30, "A"]
    queries = ["".join(rnd.choices("ACGT", k=rnd.randrange(40, 80))) for _ in range(25)] + ["", "A", refs[3]]
    kept, cut = [], nearest.cut

    def counting(df):
        out = cut(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(nearest, "cut", counting)
    out = nearest.nearest_refs(
        spark.createDataFrame([(f"q{i}", s) for i, s in enumerate(queries)], "id string, seq string"),
        spark.createDataFrame([(f"r{i}", s) for i, s in enumerate(refs)], "name string, seq string"), 5,
    )
    got = defaultdict(list)
    for r in out.orderBy("id", "rn").collect():
        got[r.id].append((r.dist, r.name))
    for i, s in enumerate(queries):
        want = sorted((distance(s, r, equal), r, f"r{j}") for j, r in enumerate(refs) if r != s)[:5]
        assert got[f"q{i}"] == [(d, n) for d, _, n in want]
    assert max(kept) < 28 * 50


def test_minimal_runs(spark):
    rnd = random.Random(4)
    cover = {(f"w{i}", r) for i in range(60) for r in range(8) if rnd.random() < 0.25}
    got = [(r.run, r.gain) for r in runs.minimal_runs(spark.createDataFrame(list(cover), "label string, run int")).collect()]
    left, want = {w for w, _ in cover}, []
    while left:
        gain = {r: len({w for w, x in cover if x == r and w in left}) for r in range(8)}
        best = min(gain, key=lambda r: (-gain[r], r))
        want.append((best, gain[best]))
        left -= {w for w, x in cover if x == best}
    assert got == want


def test_typed_parameters(spark):
    one = spark.createDataFrame([("35", "yes")], "a string, b string")
    row = one.select(runs.typed_parameter("resolve_mixed.tolerance", F.col("a")), runs.typed_parameter("resolve_mixed.enabled", F.col("b"))).first()
    assert tuple(row) == (0.35, 1.0)
    with pytest.raises(Exception, match="unusable"):
        one.select(runs.typed_parameter("minq", F.lit("999"))).collect()
    with pytest.raises(ValueError):
        runs.typed_parameter("nonsense", F.col("a"))


def test_field_criteria(spark):
    df = spark.createDataFrame([("a;5;x=Foo",), ("b;10;x=bar",), ("c",)], "header string")
    keep = lambda crit, m="all": sorted(r.header[0] for r in records.filter_fields(df, crit, m).collect())
    assert keep([(2, ">=", "6")]) == ["b"] and keep([("x", "!=", "foo")]) == ["b"]
    assert keep([(2, "=", "5"), ("x", "contains", "AR")], "any") == ["a", "b"] and keep([("x", "not contains", "5")]) == ["a", "b"]
    with pytest.raises(ValueError):
        keep([(2, ">", "word")])


def brute_haplotypes(seqs, minor=0.2, frac=0.2, tol=0.1, least=3):
    n = len(seqs)
    cols = []
    for j in range(len(seqs[0])):
        top = Counter(s[j] for s in seqs if s[j] in "ACGT").most_common(2)
        if len(top) > 1 and top[1][1] / n >= minor:
            cols.append(j)
    if n < 4 or len(cols) < 2:
        return []
    sig = [tuple(s[j] for j in cols) for s in seqs]
    reach = round(tol * len(cols))
    dist = lambda a, b: sum(x != y for x, y in zip(a, b) if x not in "-N" and y not in "-N")

    def majority(texts):
        out = []
        for col in zip(*texts):
            over = [b for b, c in Counter(col).items() if c / len(texts) > 0.5]
            out.append(over[0] if over else "N")
        return out

    free, groups = [s for s, _ in sorted(Counter(sig).items(), key=lambda kv: (-kv[1], kv[0]))], []
    while free:
        members = [s for s in free if dist(s, free[0]) <= reach]
        free = [s for s in free if s not in members]
        center = majority([s for s in sig if s in members])
        more = [s for s in free if dist(s, center) <= reach]
        free = [s for s in free if s not in more]
        groups.append([x for x, s in zip(seqs, sig) if s in members or s in more])
    groups = sorted(((len(g), "".join(majority(g))) for g in groups), key=lambda g: (-g[0], g[1]))
    return [g for g in groups if g[0] / n >= frac and g[0] >= least] or groups[:1]


def test_haplotypes(spark):
    rnd, rows, want = random.Random(8), [], {}
    for k in range(12):
        base = "".join(rnd.choice("ACGT") for _ in range(60))
        twin = "".join(rnd.choice("ACGT") if j % 13 == k % 13 else x for j, x in enumerate(base))
        third = "".join(rnd.choice("ACGT") if j % 7 == 0 else x for j, x in enumerate(base))
        seqs = []
        for _ in range(rnd.choice([3, 12, 25])):
            s = rnd.choice([base, base, twin, third])
            seqs.append("".join(rnd.choice("ACGT-N") if rnd.random() < 0.03 else x for x in s))
        rows += [(f"s{k}", i, s) for i, s in enumerate(seqs)]
        want[f"s{k}"] = brute_haplotypes(seqs)
    got = defaultdict(list)
    for r in consensus.haplotypes(spark.createDataFrame(rows, "sample string, read_id int, aln string")).orderBy("sample", "rank").collect():
        got[r.sample].append((r.size, r.aligned))
    assert dict(got) == {k: v for k, v in want.items() if v}


def test_align_to_template_gives_equal_lengths(spark):
    rnd, rows = random.Random(6), []
    for k in range(5):
        base = word(rnd, "ACGT", 50) + "ACGTACGT"
        for i in range(8):
            s = "".join(rnd.choice(["", x + "A", x, x, x, x, x, x, x]) for x in base) if i else base
            rows.append((f"s{k}", i, s, i + 1))
    aln = consensus.align_to_template(spark.createDataFrame(rows, "sample string, read_id int, seq string, rn int")).collect()
    raw = {(s, i): t for s, i, t, _ in rows}
    width = defaultdict(set)
    for r in aln:
        assert r.aln.replace("-", "") == raw[r.sample, r.read_id]
        width[r.sample].add(len(r.aln))
    assert all(len(w) == 1 for w in width.values()) and len(aln) == len(rows)


def test_sweep_equals_single_calls(spark):
    rows = [("s", i, s) for i, s in enumerate(["ACGT", "ACGT", "ACGA", "AC-A", "ACTA", "ACGA"])]
    counts = count_matrix(spark.createDataFrame(rows, "sample string, read_id int, aln string"))
    combos = spark.createDataFrame([(1, 0.3), (2, 0.6)], "run int, threshold double")
    swept = {r.threshold: r.seq for r in phases.sweep_thresholds(counts, combos, 0, 0, 0).collect()}
    for t in (0.3, 0.6):
        assert swept[t] == consensus.call_columns(counts, t, 5).first().seq


def test_sequence_rules(spark):
    df = spark.createDataFrame([("ATGTAAGGG",), ("",), ("NNN",), ("acgtn-u",)], "seq string")
    assert [r[0] for r in df.select(S.revcomp(S.revcomp("seq"))).collect()] == [r.seq for r in df.collect()]
    row = df.select(S.orf_lengths("seq", 1)).first()[0]
    assert row[0] == 1
    assert df.select(F.round(S.mean_q(F.lit("IIII")), 6)).first()[0] == 40.0
    empty = df.filter("seq = ''").select(S.mean_q("seq")).first()[0]
    assert empty is None


def test_blank_queries_dropped(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "i int, query_name string")
    assert identify.fix_blank_query(df, ["i"], "drop").count() == 1


def test_sql_functions(spark):
    from ampliq.functions import sql

    sql.register(spark)
    row = spark.sql("SELECT revcomp('ACR'), gc_pct('GGAT'), sample_of_header('s_var2;x'), sample_of_header('t_all.fa;1'), parse_number('99,5 %'), max_homopolymer('AA-AT'), normalize_cell(' Á. b, ')").first()
    assert tuple(row) == ("YGT", 50.0, "s", "t", 99.5, 3, "A_b")


def test_costly_column_is_worked_out_once_for_each_reader(spark):
    """A join's filter on a key made from a header is not written out in terms of the whole text below the view."""
    from ampliq.catalog.fixtures import Fixtures

    runs = Fixtures(spark, "/root/testdata/sf0.001").runs
    key = F.substring_index("header", ";", 1).alias("id")
    both = runs.filter("run = 1").select(key).join(runs.filter("run = 2").select(key), "id", "left_anti")
    assert both._jdf.queryExecution().executedPlan().toString().count("regexp_replace") == 2


def test_ids_only_in_one_run_take_one_pass(spark):
    from ampliq.operators import compare

    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "a"), (3, "d"), (1, "e"), (None, "e")]
    found = compare.only_in(spark.createDataFrame(rows, "run int, id string"), 1, 2)
    assert sorted(r.id for r in found.collect()) == ["a", "e"]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
