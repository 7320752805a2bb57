import pyarrow as pa
import pytest

from tesselar.operators import kernels


def test_sums(spark):
    ints = spark.range(10_001).withColumnRenamed("id", "v")
    assert kernels.sum_serial(ints, "v").first().total == 50_005_000
    assert kernels.sum_parallel(ints, "v").first().total == 50_005_000
    got = kernels.user_sum(ints.selectExpr("v % 3 as g", "v"), "g", "v").collect()
    assert {r.g: r.total for r in got} == {k: sum(range(k, 10_001, 3)) for k in range(3)}


def test_kernel(spark):
    ints = spark.range(100).selectExpr("id as idx", "id as v")
    source = "import pyarrow as pa, pyarrow.compute as pc\ndef kernel(b, args):\n    return pa.RecordBatch.from_arrays([b.column(0), pc.add(b.column(1), args['n'])], names=['idx', 'w'])\n"
    k = kernels.Kernel(spark).build(source).bind(ints).args(n=5)
    assert k.dispatch(3, "idx long, w long").where("w <> idx + 5").count() == 0
    assert k.sync(k.args(n=6).dispatch_elements("idx long, w long").where("w = idx + 6")) == 100
    named = kernels.Kernel(spark).build("tesselar.operators.kernels:scaled").bind(ints).args(factor=2, shift=1)
    assert named.dispatch_elements("idx long, w long").where("w <> 2 * idx + 1").count() == 0
    with pytest.raises(ValueError):
        kernels.Kernel(spark).build("x = 1\n")
    with pytest.raises(ValueError):
        kernels.Kernel(spark).build(source).dispatch(2, "idx long")


def test_user_reduction(spark):
    """Least value and number of rows of a group, in partial and final steps by the same code."""
    rows = spark.range(5000).selectExpr("id % 7 as g", "(id * 37) % 1009 as low", "1L as n").repartition(5)

    def reduce(t):
        out = t.group_by("g").aggregate([("low", "min"), ("n", "sum")])
        return pa.table({"n": out.column("n_sum"), "low": out.column("low_min"), "g": out.column("g")})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # several batches a task
    got = kernels.user_reduce(rows, reduce, "g long, low long, n long", "g").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {k: (min(i * 37 % 1009 for i in range(k, 5000, 7)), len(range(k, 5000, 7))) for k in range(7)}
    assert {r.g: (r.low, r.n) for r in got} == want and len(got) == 7
    assert kernels.user_reduce(rows.where("false"), reduce, "g long, low long, n long", "g").count() == 0


def test_include(spark, tmp_path):
    """A kernel on the executors uses a helper file that was included."""
    (tmp_path / "shift_helper.py").write_text("def shift():\n    return 40\n")
    source = "import pyarrow as pa, pyarrow.compute as pc\ndef kernel(b, args):\n    import shift_helper\n    return pa.RecordBatch.from_arrays([b.column(0), pc.add(b.column(0), shift_helper.shift())], names=['idx', 'w'])\n"
    k = kernels.Kernel(spark).include(str(tmp_path / "shift_helper.py")).build(source).bind(spark.range(50).withColumnRenamed("id", "idx"))
    out = k.dispatch(2, "idx long, w long").collect()
    assert len(out) == 50 and all(r.w == r.idx + 40 for r in out)


def test_kernel_of_a_table_argument(spark):
    """A partition's rows come together and in order, also if they are more than a batch."""
    kernels.register_table_function(spark, "gaps_test", kernels.gaps, "g long, idx long, gap long")
    spark.range(3000).selectExpr("id % 5 as g", "id as idx", "(id * 7919) % 1000 as v").repartition(6).createOrReplaceTempView("gaps_rows")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {(r.g, r.idx): r.gap for r in spark.sql("SELECT * FROM gaps_test(TABLE(gaps_rows) PARTITION BY g ORDER BY idx)").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    v = lambda i: i * 7919 % 1000
    assert got == {(i % 5, i): v(i) - v(i - 5) if i >= 5 else 0 for i in range(3000)}
    assert spark.sql("SELECT * FROM gaps_test(TABLE(SELECT * FROM gaps_rows WHERE false) PARTITION BY g)").count() == 0


def test_one_hot_key_is_reduced_by_many_tasks(spark, tmp_path):
    """Partial results of one key are dealt to many tasks, and the last task gets few of them."""
    rows = spark.range(200_000, numPartitions=40).selectExpr("0L as g", "id as v")
    log = str(tmp_path)

    def reduce(t):
        import os
        import uuid

        from pyspark import TaskContext

        c = TaskContext.get()
        with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
            f.write(f"{c.stageId()} {c.partitionId()} {t.num_rows}")
        return kernels.summed(t)

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = kernels.user_reduce(rows, reduce, "g long, v long", "g").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [(r.g, r.v) for r in got] == [(0, sum(range(200_000)))]
    tasks = {}
    for p in tmp_path.iterdir():
        stage, part, n = map(int, p.read_text().split())
        tasks.setdefault(stage, {}).setdefault(part, []).append(n)
    first, middle, last = (tasks[s] for s in sorted(tasks))
    assert len(first) == 40 and len(middle) >= 8 and len(last) == 1
    assert sum(map(len, last.values())) <= 2 and max(last.popitem()[1]) <= 40
