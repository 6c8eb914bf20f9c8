"""Late results against a plain loop, and a stream of repeated, shuffled batches against one batch."""

import random

from pyspark.sql import functions as F

from factloom.streaming import feedback

FACTS = "fact_id int, status string, value double, raw string, period_key string"
RESULTS = "task_id string, name string, period_key string, value_raw string, value_num string"


def tables(spark, seed=2):
    draw = random.Random(seed)
    facts = [(k, draw.choice(["review", "observed", "conflict", "blank", None]), draw.choice([None, 1.0, 2.0]), "old", "p") for k in range(200)]
    reviews = [(f"r{k}", draw.sample(range(210), draw.randrange(4))) for k in range(90)]
    tasks = [(f"t{k}", f"r{draw.randrange(100)}") for k in range(120)]
    results = [(f"t{draw.randrange(130)}", f"{draw.randrange(1000):03}-{k}", draw.choice(["", None, f"d{k}__x"]), draw.choice(["", f"raw{k}"]), draw.choice(["", None, "x", "1e3", f" {k}.5 "])) for k in range(200)]
    return facts, tasks, reviews, results


def frames(spark, facts, tasks, reviews, results):
    return spark.createDataFrame(facts, FACTS), spark.createDataFrame(tasks, "task_id string, review_id string"), spark.createDataFrame(reviews, "review_id string, fact_ids array<int>"), spark.createDataFrame(results, RESULTS)


def plain(facts, tasks, reviews, results):
    state = {f[0]: [*f[1:], False] for f in facts}
    task, review, log = dict(tasks), dict(reviews), []
    for t, name, period, raw, number in sorted(results, key=lambda r: (r[1], r[0])):
        if t not in task or task[t] not in review:
            log.append((t, name, None, "ignored", "review_not_found" if t in task else "task_not_found"))
            continue
        for f in review[task[t]]:
            if f not in state:
                continue
            fact = state[f]
            if fact[0] not in feedback.OPEN and fact[1] is not None:
                log.append((t, name, f, "ignored", "strong_resolved_fact_exists"))
                continue
            fact[3], fact[2], fact[4] = period or fact[3], raw or fact[2], True
            try:
                fact[1] = float(number)
                fact[0] = "observed" if fact[0] in feedback.OPEN else fact[0]
            except (TypeError, ValueError):
                pass
            log.append((t, name, f, "merged", "merged_into_unresolved_fact"))
    return {f: tuple(v) for f, v in state.items()}, sorted(log, key=repr)


def test_results_are_merged_as_by_a_plain_loop(spark):
    data = tables(spark)
    dfs = frames(spark, *data)
    state, log = plain(*data)
    got = {r.fact_id: (r.status, r.value, r.raw, r.period_key, r.reocr) for r in feedback.merged(*dfs).collect()}
    assert {k: (got[k], v) for k, v in state.items() if got[k] != v} == {} and len(got) == len(state)
    assert sorted((tuple(r) for r in feedback.audit(*dfs).collect()), key=repr) == log
    assert len({x[4] for x in log}) == 4


def test_a_stream_of_repeated_and_shuffled_batches_is_one_batch(spark, tmp_path):
    facts, tasks, reviews, results = tables(spark, 5)
    dfs = frames(spark, facts, tasks, reviews, results)
    want = sorted(map(tuple, feedback.merged(*dfs).collect()))
    draw, log = random.Random(1), str(tmp_path / "log")
    draw.shuffle(results)
    for k in range(4):
        # Every part comes with some of the results that came before; the stream is stopped and resumed.
        part = results[k * 50 : k * 50 + 50] + draw.sample(results[: k * 50 + 50], 20)
        spark.createDataFrame(part, RESULTS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(RESULTS).json(str(tmp_path / "in"))
        feedback.log_results(stream, log, str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, feedback.merged(*dfs[:3], feedback.logged(spark, log)).collect())) == want
    # The same files read by a new stream write the same log again.
    feedback.log_results(spark.readStream.schema(RESULTS).json(str(tmp_path / "in")), log, str(tmp_path / "other")).awaitTermination()
    assert sorted(map(tuple, feedback.merged(*dfs[:3], feedback.logged(spark, log)).collect())) == want


def test_results_are_not_paired_with_facts(spark):
    """One review of many facts and many results; half of the facts are also in a second review that closes them earlier."""
    n = 3000
    facts = spark.range(n).selectExpr("id AS fact_id", "CAST(NULL AS DOUBLE) AS value", "'' AS raw", "'p' AS period_key", "'review' AS status")
    reviews = facts.groupBy().agg(F.collect_list("fact_id").alias("fact_ids")).selectExpr("'R' AS review_id", "fact_ids")
    reviews = reviews.unionByName(facts.filter("fact_id < 1500").groupBy().agg(F.collect_list("fact_id").alias("fact_ids")).selectExpr("'S' AS review_id", "fact_ids"))
    tasks = spark.createDataFrame([("T", "R"), ("U", "S")], "task_id string, review_id string")
    results = spark.range(n).selectExpr("'T' AS task_id", "lpad(CAST(id AS STRING), 6, '0') AS name", "'' AS period_key", "concat('raw', id) AS value_raw", "IF(id >= 2000, CAST(id AS STRING), '') AS value_num")
    results = results.unionByName(spark.createDataFrame([("U", "001000x", "late", "", "7")], results.schema))
    got = feedback.merged(facts, tasks, reviews, results)
    said = got.groupBy("value", "raw", "period_key", "status").count().collect()
    assert {tuple(r) for r in said} == {(7.0, "raw1000", "late", "observed", 1500), (2000.0, "raw2000", "p", "observed", 1500)}
    # The step that makes a row for each fact and result marks it as reviewed; only audit() needs those.
    assert "reviewed" not in got._jdf.queryExecution().analyzed().toString()
