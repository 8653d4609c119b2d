import itertools
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from bitloom.errors import BitloomError, DataLoadError, FrameError, InvalidDataType, InvalidFeatureSpec, MissingSample
from bitloom.operators import basetable, condense, encode, entropy, ingest, normalize, selection
from bitloom.operators.distinct import ExactCounter, HyperLogLogCounter, count_distinct
from bitloom.operators.normalize import Options
from bitloom.operators.ordered import with_position, with_previous, with_running_total
from bitloom.plans.chain import Chain
from bitloom.plans.compress import Plan, compress, compress_batch, compress_normalized
from bitloom.schema import DatasetInfo, Feature, bits_needed_nonzero, min_position_bits, smallest_unsigned

# rows of eight bits, bit 0 first
MATRIX = ["10100110", "11011100", "01101011", "10001101", "01001101", "11011100"]


def bit_rows(spark, rows):
    """A dataset of one feature whose bits are the strings, bit 0 first."""
    width = len(rows[0])
    info = DatasetInfo([Feature("f", "int64", width)], len(rows))
    return spark.createDataFrame([(i, int(r[::-1], 2)) for i, r in enumerate(rows)], "row_idx long, f long"), info


def one(spark, values, kind, options=Options()):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"row_idx long, v {kind}")
    rows, info = normalize.normalize(df, "row_idx", None, options)
    return info.features[0], [r["v"] for r in rows.orderBy("row_idx").collect()], rows, info


def test_type_widths():
    limits = {0: 8, 255: 8, 256: 16, 65535: 16, 65536: 32, 2**32 - 1: 32, 2**32: 64, 2**64 - 1: 64, 2**64: 128}
    assert {m: smallest_unsigned(m) for m in limits} == limits
    assert [bits_needed_nonzero(n) for n in (0, 1, 2, 3, 4, 5, 256, 257)] == [1, 1, 1, 2, 2, 3, 8, 9]
    assert [min_position_bits(n) for n in (0, 1, 2, 3, 9)] == [0, 0, 1, 2, 4]


def test_signed_and_float_columns(spark):
    f, values, *_ = one(spark, [-10, 0, 5, 20], "int")
    assert (f.minimum, f.bits, values) == (-10, 8, [0, 10, 15, 30])
    f, values, *_ = one(spark, [1.5, 2.25, 0.75], "double", Options(decimals=2))
    assert (f.minimum, values) == (75, [75, 150, 0])
    f, values, *_ = one(spark, [100, 105, 110], "bigint")
    assert (f.minimum, f.bits, values) == (100, 8, [0, 5, 10])


@pytest.mark.parametrize(
    "values, kind, options",
    [
        ([-(2**63), 2**63 - 1, 0, -1], "bigint", Options()),
        ([-(2**63), 2**63 - 1, 7], "bigint", Options(zero_integers=False)),
        ([1.1, -0.5, 1e300, float("inf")], "double", Options(floats="raw")),
        ([1.5, -2.25], "float", Options(floats="raw")),
        ([1.5, -2.25, 1000.125], "double", Options(floats="scaled", decimals=3)),
        ([-128, 127], "tinyint", Options()),
    ],
)
def test_reconstruction_is_exact(spark, values, kind, options):
    _, _, rows, info = one(spark, values, kind, options)
    back = normalize.reconstruct(rows, info).orderBy("row_idx")
    assert [r["v"] for r in back.collect()] == values and dict(back.dtypes)["v"] == kind


def test_unsigned_64_bits(spark):
    from decimal import Decimal

    values = [Decimal(0), Decimal(2**64 - 1), Decimal(2**63)]
    _, _, rows, info = one(spark, values, "decimal(20,0)")
    assert info.features[0].bits == 64
    assert [r["v"] for r in normalize.reconstruct(rows, info).orderBy("row_idx").collect()] == values


def test_refused_columns(spark):
    with pytest.raises(InvalidDataType):
        one(spark, ["a"], "string")
    with pytest.raises(DataLoadError):
        one(spark, [1, None], "int")
    with pytest.raises(InvalidFeatureSpec):
        one(spark, [1.0, float("nan")], "double")
    with pytest.raises(FrameError):
        one(spark, [], "int")
    with pytest.raises(InvalidFeatureSpec):
        one(spark, [1e15], "double")


def test_golden_entropies_and_constants(spark):
    rows, info = bit_rows(spark, MATRIX)
    scores = entropy.bit_scores(rows, info)
    assert [round(s.entropy, 5) for s in scores] == [0.9183, 0.9183, 0.9183, 0.9183, 0.65002, 0.65002, 0.9183, 1.0]
    rows, info = bit_rows(spark, ["0110", "0100", "0111", "0101"])
    assert entropy.constant_bits(entropy.bit_scores(rows, info)) == ([0], [1])
    extra, _ = bit_rows(spark, ["1100"])
    assert entropy.still_constant(extra, info, [0], [1]) == ([], [1])


def test_curve_equals_direct_counts(spark):
    rng = random.Random(3)
    for widths in ((7, 3), (40, 35)):
        info = DatasetInfo([Feature(f"f{i}", "int64", w) for i, w in enumerate(widths)], 60)
        data = [(r, *[rng.getrandbits(w) & rng.getrandbits(w) for w in widths]) for r in range(60)]
        rows = spark.createDataFrame(data, "row_idx long, f0 long, f1 long")
        order = list(range(info.chunk_size))
        rng.shuffle(order)
        curve = ExactCounter().curve(rows, info, order)
        for k in (0, 1, 3, 5, 9, info.chunk_size):
            assert curve[k] == count_distinct(rows, info, order[:k])
        approximate = HyperLogLogCounter().curve(rows, info, order)
        assert all(abs(a - e) <= 0.2 * e + 1 for a, e in zip(approximate, curve, strict=True))


def _refined(data, order, info, method, patience, scores, threshold=0.5, decay=0.5):
    """The selectors said literally: count distinct prefixes as the walk goes."""
    n = len(data)
    constants = sum(s.constant for s in scores)
    by_bit = {s.bit: s.entropy for s in scores}

    def size(k):
        n_b = len({tuple(row[b] for b in order[:k]) for row in data})
        return n_b * k + n * (info.chunk_size - k) + n * bits_needed_nonzero(n_b) + 16 * len(info.features) + 16 + info.chunk_size

    best, best_size = constants, size(constants)
    if method == "threshold":
        best = max(constants, sum(by_bit[b] <= threshold for b in order))
        best_size = size(best)
    if method == "adaptive":
        for c in selection.entropy_clusters([by_bit[b] for b in order[constants:]], decay):
            if size(best + c) >= best_size:
                break
            best, best_size = best + c, size(best + c)
    fails = 0
    for k in range(best + 1, len(order) + 1):
        if size(k) < best_size:
            best, best_size, fails = k, size(k), 0
        else:
            fails += 1
        if fails >= patience:
            break
    return best, best_size


def test_selectors_equal_a_literal_walk(spark):
    rng = random.Random(5)
    for _ in range(3):
        width, n = 12, 80
        p = [rng.choice([0.0, 0.02, 0.1, 0.5, 1.0]) for _ in range(width)]
        data = [[int(rng.random() < q) for q in p] for _ in range(n)]
        rows, info = bit_rows(spark, ["".join(map(str, r)) for r in data])
        scores = entropy.bit_scores(rows, info)
        order = entropy.entropy_order(scores)
        curve = ExactCounter().curve(rows, info, order)
        constants, entropies = sum(s.constant for s in scores), [next(s.entropy for s in scores if s.bit == b) for b in order]
        for patience in (1, 3):
            found = selection.select_naive(order, curve, constants, n, info, patience)
            assert (found.k, found.size) == _refined(data, order, info, "naive", patience, scores)
            found = selection.select_threshold(order, curve, constants, n, info, patience, entropies, 0.5)
            assert (found.k, found.size) == _refined(data, order, info, "threshold", patience, scores)
            found = selection.select_adaptive(order, curve, constants, n, info, patience, entropies)
            assert (found.k, found.size) == _refined(data, order, info, "adaptive", patience, scores)
        assert selection.profile_all(order, curve, n, info).k == width


def test_clusters():
    sizes = selection.entropy_clusters([float(i) for i in range(16)], 0.5)
    assert sum(sizes) == 16 and sizes[0] == max(sizes) and sizes[-1] == 1
    assert selection.entropy_clusters([0.3] * 10, 0.5) == [10] and selection.entropy_clusters([], 0.5) == []
    assert selection.entropy_clusters([0.01] * 90 + [0.9] * 10, 0.5)[0] >= 90


def test_layout_and_sorted_table(spark):
    rows, info = bit_rows(spark, ["0001", "0101", "1011", "1111"])
    layout = basetable.Layout.of(info, [0, 1, 3], [], [3])
    assert layout.variable == [0, 1] and layout.positions(basetable.ONE) == [3] and layout.deviation == [2]
    bases, _ = basetable.build(rows, info, layout)
    assert bases.count() == 4
    rows, info = bit_rows(spark, ["1010", "0001", "1011", "0111"])
    layout = basetable.Layout.of(info, [0, 1, 2, 3], [], [])
    bases, order = basetable.build(rows, info, layout, True)
    assert order == [1, 2, 3, 0]
    table = {r["base_id"]: f"{r['f']:04b}"[::-1] for r in bases.collect()}
    assert [table[i] for i in range(4)] == ["0111", "1011", "1010", "0001"]
    ids = basetable.assign(rows, info, layout, bases).orderBy("row_idx").collect()
    assert [r["base_id"] for r in ids] == [2, 3, 1, 0]
    assert basetable.new_positions({1}, [1, 4, 4, 5]) == [4, 5] and basetable.union_positions([3, 1], [1]) == [1, 3]


def test_condensed_weights(spark):
    rows, info = bit_rows(spark, MATRIX * 10)
    scores = entropy.bit_scores(rows, info)
    found, bits = condense.condense(rows, info, scores, 3)
    assert found.agg(F.sum("weight")).first()[0] == 60 and found.count() >= 3
    data = [int(r[::-1], 2) for r in MATRIX * 10]
    mask = sum(1 << b for b in bits)
    groups = {}
    for v in data:
        groups.setdefault(v & mask, []).append(v & ~mask & 255)
    assert sorted((len(d), (b + sum(d) // len(d)) & 255) for b, d in groups.items()) == sorted((r["weight"], r["f"]) for r in found.collect())
    zeros, zinfo = bit_rows(spark, ["0000"] * 4)
    found, _ = condense.condense(zeros, zinfo, entropy.bit_scores(zeros, zinfo), 2)
    assert [tuple(r) for r in found.collect()] == [(4, 0)]


def test_random_access(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    c = compress(df, "event_id", plan=Plan(options=Options(decimals=2), block_rows=64))
    every = {r["event_id"]: (r["user_id"], r["value"]) for r in df.collect()}
    assert {r["row_idx"]: (r["user_id"], r["value"]) for r in c.decompress(check=True).collect()} == every
    found = [(r["row_idx"], r["user_id"], r["value"]) for r in c.rows_at([7, 3, 3, 100]).collect()]
    assert found == [(i, *every[i]) for i in (3, 3, 7, 100)]
    assert c.rows_at([]).count() == 0 and c.rows_between([(5, 9), (8, 12)]).count() == 8
    with pytest.raises(MissingSample):
        c.rows_at([len(every)])
    assert c.analytics().agg(F.sum("weight")).first()[0] == len(every)
    assert c.base_samples().agg(F.sum("weight")).first()[0] == len(every)


def test_appended_condensed_rows_stay_out_of_the_data(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    c = compress(df, "o_orderkey", plan=Plan(options=Options(decimals=2), append_condensed=True))
    assert sum(c.info.weights) == c.info.n == df.count()
    back = c.decompress()
    assert back.count() == df.count() and back.exceptAll(df.toDF("row_idx", "o_custkey", "o_totalprice")).count() == 0


def test_frozen_layout(spark):
    rows, info = bit_rows(spark, MATRIX)
    c = compress_normalized(rows, info, Plan(m_max=None))
    again = compress_batch(rows, info, c.layout)
    assert again.normalized().exceptAll(rows).count() == 0
    fixed, finfo = bit_rows(spark, ["0110", "0100"])
    layout = compress_normalized(fixed, finfo, Plan(m_max=None)).layout
    with pytest.raises(BitloomError):
        compress_batch(bit_rows(spark, ["1111"])[0], finfo, layout)


def _literal_pairs(symbols):
    """Runs and literals of one block, said as a loop over rows."""
    out, i, n = [], 0, len(symbols)

    def run_at(j):
        k = 1
        while j + k < n and k < 136 and symbols[j + k] == symbols[j]:
            k += 1
        return k

    while i < n:
        start, run = i, run_at(i)
        r = run - 1 if run >= 2 else 0
        i += run if run >= 2 else 0
        m = 0
        while i < n and m < 135 and run_at(i) < 2:
            i, m = i + 1, m + 1
        out.append((start, r, m))
    return out


def test_run_pairs(spark):
    rng = random.Random(2)
    symbols = [0] * 300 + [rng.randrange(1000) for _ in range(400)] + [5] * 137 + [1, 2, 2, 3] + [7] * 136 + [8] + list(range(46))
    rows = spark.createDataFrame([(i, i // 1024, s) for i, s in enumerate(symbols)], "row_idx long, block_id long, s long")
    found = sorted((r["start"], r["r"], r["m"]) for r in encode.run_pairs(rows, ["s"]).collect())
    assert found == _literal_pairs(symbols)
    assert encode.expand_runs(encode.islands(rows, ["s"]), ["s"]).exceptAll(rows.select("row_idx", "s")).count() == 0


def _literal_package_merge(frequencies, longest):
    leaves, packages = sorted((f, (s,)) for s, f in frequencies.items()), []
    for _ in range(longest):
        paired = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(packages[::2], packages[1::2], strict=False)]
        packages = sorted(paired + leaves, key=lambda x: x[0])
    taken = [s for _, symbols in packages[: 2 * len(leaves) - 2] for s in symbols]
    return {s: taken.count(s) for s in frequencies}


def test_limited_code_lengths():
    draw = random.Random(5)
    for _ in range(40):
        found = {s: draw.choice([0, 1, 1, 2, 3, 50, 1000]) for s in draw.sample(range(100), draw.randint(2, 20))}
        for longest in (5, 6, 9):
            assert encode.limited_lengths(found, longest) == _literal_package_merge(found, longest)
    # rare symbols beside frequent ones need the limit; the memory stays small
    many = {s: 1 + s % 7 for s in range(20_000)} | {20_000 + k: 1 << 14 + k for k in range(20)}
    tracemalloc.start()
    lengths = encode.code_lengths(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(lengths.values()) == encode.MAX_CODE and len(encode.canonical_codes(lengths)) == len(many)
    assert peak < 20 << 20


def test_huffman():
    lengths = encode.code_lengths({0: 5, 1: 1, 2: 1, 3: 2})
    assert lengths == {0: 1, 3: 2, 1: 3, 2: 3}
    assert encode.code_lengths({4: 9}) == {4: 1}
    steep = {i: max(1, int(1.7**i)) for i in range(40)}
    limited = encode.code_lengths(steep)
    assert max(limited.values()) <= encode.MAX_CODE and sum(2.0**-n for n in limited.values()) <= 1
    assert encode.limited_lengths({0: 5, 1: 1, 2: 1, 3: 2}, 3) == lengths
    codes = {f"{c:0{n}b}" for _, n, c in encode.canonical_codes(limited)}
    assert not any(a != b and b.startswith(a) for a, b in itertools.product(codes, codes))


def test_order_helpers(spark):
    rng = random.Random(1)
    values = [rng.randrange(100) for _ in range(9000)]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long")
    placed = with_position(rows, [F.col("v"), F.col("i")], "p")
    expected = sorted((v, i) for i, v in enumerate(values))
    assert [(r["v"], r["i"]) for r in placed.orderBy("p").collect()] == expected
    total = {r["p"]: r["t"] for r in with_running_total(placed, "p", "v", "t").collect()}
    before = list(itertools.accumulate([0] + [v for v, _ in expected]))
    assert all(total[p] == before[p] for p in range(9000))
    assert with_previous(placed, "p", ["v"]).where("prev_v is null").count() == 1


def test_fill_and_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2.5\n,3.5\n3,\n")
    df = ingest.load_csv(spark, str(tmp_path / "t.csv"), fill="forward").orderBy("row_idx")
    assert [tuple(r) for r in df.select("a", "b").collect()] == [(1, 2.5), (1, 3.5), (3, 3.5)]
    df = ingest.load_csv(spark, str(tmp_path / "t.csv"), fill="mean").orderBy("row_idx")
    assert [r["a"] for r in df.collect()] == [1, 2, 3]
    with pytest.raises(DataLoadError):
        ingest.fill_nulls(df, "guess", ["a"])
    (tmp_path / "h.csv").write_text("bit_len,count\n3,5\n3,2\n4,0\n")
    assert [tuple(r) for r in ingest.load_histogram(spark, str(tmp_path / "h.csv")).collect()] == [(3, 7)]


def test_chain():
    assert Chain().then(lambda x: x + 1).then(str)(4) == "5"


def test_public_names():
    import bitloom

    assert all(callable(getattr(bitloom, n)) for n in bitloom.__all__)
    with pytest.raises(AttributeError):
        bitloom.nothing


def test_no_base_bits(spark):
    rows, info = bit_rows(spark, MATRIX)
    layout = basetable.Layout.of(info, [], [], [])
    bases, _ = basetable.build(rows, info, layout)
    encoded = basetable.assign(rows, info, layout, bases)
    assert bases.count() == 1 and basetable.merge(encoded, info, bases).exceptAll(rows).count() == 0


def test_bit_lengths_are_exact(spark):
    values = sorted({v for k in range(127) for v in ((1 << k) - 1, 1 << k, (1 << k) + 1) if 0 <= v < 1 << 126})
    rows = spark.createDataFrame([(str(v),) for v in values], "v string")
    wide = rows.select("v", encode.bit_length(F.col("v").cast("decimal(38,0)"), "decimal(38,0)").alias("b")).collect()
    assert all(r["b"] == int(r["v"]).bit_length() for r in wide)
    narrow = rows.where(F.length("v") < 19).select("v", encode.bit_length(F.col("v").cast("bigint"), "bigint").alias("b")).collect()
    assert narrow and all(r["b"] == int(r["v"]).bit_length() for r in narrow)


def test_wide_deltas_come_back(spark):
    keys = sorted({(1 << 125) - 3, 1 << 100, (1 << 100) - 1, (1 << 70) - 1, 1 << 64, 12345, 0}, reverse=True)
    frame = spark.createDataFrame([(i, str(k)) for i, k in enumerate(keys)], "base_id long, key string").withColumn("key", F.col("key").cast("decimal(38,0)"))
    found = encode.deltas(frame, key_bits=126)
    assert {r["base_id"]: r["bit_length"] for r in found.collect()} == {i + 1: (a - b - 1).bit_length() for i, (a, b) in enumerate(zip(keys, keys[1:]))}
    assert [int(r["key"]) for r in encode.undo_deltas(keys[0], found).orderBy("base_id").collect()] == keys


def test_too_many_symbols_get_ids_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(encode, "MAX_SYMBOLS", 3)
    bases = spark.createDataFrame([(i, 1) for i in range(5)], "base_id long, cnt long")
    codes = encode.code_table(spark, bases).orderBy("base_id").collect()
    assert [(r["base_id"], r["code_len"], r["code"]) for r in codes] == [(i, 3, i) for i in range(5)]
    encoded = spark.createDataFrame([(0, 1), (0, 4), (1, 2)], "block_id long, base_id long")
    assert {(r["block_id"], r["bits"], r["bit_offset"]) for r in encode.block_code_offsets(encoded, encode.code_table(spark, bases)).collect()} == {(0, 6, 0), (1, 3, 6)}


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from bitloom.operators import ordered

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(RuntimeError):
        ordered.shared_folder(session("spark://host:7077"))
    assert ordered.shared_folder(session("yarn", "hdfs://x/y/")) == "hdfs://x/y" and ordered.shared_folder(session("local[4]")).startswith("file://")


def test_scratch_is_cleared(spark, tmp_path):
    from bitloom.operators import ordered

    kept, ordered._made[:] = list(ordered._made), []
    path = ordered.scratch(spark, "t")
    spark.range(3).write.parquet(path)
    assert ordered.clear_scratch(spark) == 1 and ordered.clear_scratch(spark) == 0
    first, second = ordered.settle(spark.range(3), "a"), ordered.settle(spark.range(4), "b")
    mark = ordered.scratch_mark()
    third, fourth = ordered.settle(spark.range(5), "c"), ordered.settle(spark.range(6), "d")
    assert ordered.clear_scratch(spark, mark, keep=third) == 1 and third.count() == 5 and second.count() == 4
    ordered.release(first, third)
    assert ordered.scratch_mark() == 1 and second.count() == 4 and ordered.clear_scratch(spark) == 1
    ordered._made[:] = kept
