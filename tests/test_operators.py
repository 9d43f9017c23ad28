import pytest
from pyspark.sql import functions as F

from textweir.functions import sql
from textweir.kernels import profanity as P
from textweir.kernels import spam as K
from textweir.operators import profanity as ops
from textweir.operators import scanners as S
from textweir.operators import spam
from textweir.plans.pipeline import TextPipeline, TextRangePipeline, cached
from textweir.streaming.spam import guard_stream

TEXTS = [("mail user@example.com or https://example.com/a",), ("call +1 202 555 0187 now",), (None,), ("",), ("nothing here",), ("fuck user at example dot com",)]


@pytest.fixture()
def texts(spark):
    return spark.createDataFrame(TEXTS, "text string")


def test_scanners(texts):
    for s in (S.url_scanner(), S.email_scanner(), S.phone_scanner(), ops.scanner(P.english_filter())):
        rows = texts.select("text", s.scan("text").alias("r"), s.check("text").alias("c"), s.censor("text").alias("o")).collect()
        for r in rows:
            assert [tuple(x) for x in r.r] == s.kernel(r.text or "") and r.c == bool(r.r) and len(r.o) == len(r.text or "")
        assert s.matching(texts).count() == sum(bool(r.r) for r in rows)


def test_one_mask_and_sequential(texts):
    p = TextRangePipeline().use(S.email_scanner()).use(S.url_scanner()).use(S.phone_scanner())
    out = p.process(texts).collect()
    assert out[0].censored == "mail **************** or *********************" and [x.name for x in out[0].results] == ["email", "url", "phone"]
    assert [r.c for r in texts.select(p.check("text").alias("c")).collect()] == [True, True, False, False, False, True]
    assert [r.c for r in texts.select(p.censor("text", "#").alias("c")).collect()][1] == "call ############### now"
    with pytest.raises(TypeError):
        TextRangePipeline().use("url")
    q = TextPipeline().use(S.email_scanner()).use(lambda c: F.upper(c))
    assert texts.select(q.censor("text").alias("c")).first().c == "MAIL **************** OR HTTPS://EXAMPLE.COM/A"
    bad = S.custom_scanner("bad", lambda t: [(0, 2), (1.0, 3.0), (5, 5), (float("nan"), 2)])
    assert texts.limit(1).select(bad.scan("text")).first()[0] == [(0, 3)]


def test_guards_stop_rows_before_later_guards(spark):
    d = spark.createDataFrame([(1, "a", "x", 0.0), (2, "a", "y", 100.0), (3, "a", "", 5000.0), (4, "b", "mail a@b.cd", 0.0)], "seq int, actor_key string, text string, now_ms double")
    seen = []

    def second(df):
        seen.append(sorted(r.seq for r in df.collect()))
        return df.withColumn("decision", F.struct(F.lit(True).alias("allowed"), F.lit(None).cast("string").alias("reason")))

    out = {r.seq: (r.allowed, r.reason, r.output) for r in TextPipeline().guard(spam.guard()).guard(second).use(S.email_scanner()).process(d).collect()}
    assert out == {1: (True, None, "x"), 2: (False, "too_fast", None), 3: (False, "empty", None), 4: (True, None, "mail ******")}
    assert seen[0] == [1, 4]


def test_two_spam_guards_in_one_pass_each(spark):
    rows, df = messages(spark)
    first, second = K.SpamConfig(duplicate_window_ms=0), K.SpamConfig(min_interval_ms=0, duplicate_window_ms=9000, burst_max_messages=2)
    a, b, want = K.SpamGuard(first), K.SpamGuard(second), {}
    for seq, actor, text, now in rows:
        want[seq] = a.check(actor, text, now) or b.check(actor, text, now)
    out = TextPipeline().guard(spam.guard(first)).guard(spam.guard(second)).check(df)
    assert {r.seq: r.reason for r in out.collect()} == want and out.where("allowed <> (reason is null)").isEmpty()


def fold(steps, **options):
    g = K.SpamGuard(**options)
    return [g.check(*s) for s in steps]


def test_spam_kernel():
    assert fold([("a", "same", 1000), ("a", "same", 1500), ("a", "same", 2001)], min_interval_ms=0, duplicate_window_ms=1000) == [None, "duplicate", None]
    assert fold([("a", "x", 0), ("a", "y", 699), ("a", "y", 700)]) == [None, "too_fast", None]
    assert fold([("a", "x", -5), ("a", "y", 0)]) == [None, None]
    assert fold([("a", str(i), i * 1000) for i in range(8)]) == [None] * 6 + ["burst"] * 2
    assert fold([("a", "x", 0), ("a", "y", 600), ("a", "z", 1250)], track_rejected_attempts=True) == [None, "too_fast", "too_fast"]
    assert fold([(None, "x", 0), (" ​", "x", 5000)]) == [None, "duplicate"]
    assert fold([(None, "x", 0)], actor_key_policy="reject_missing") == ["missing_actor"]
    assert fold([("a", " ​", 0)]) == ["empty"]
    assert fold([("a", "x", 0), ("b", "x", 1), ("a", "x", 2)], max_actors=1, min_interval_ms=0) == [None, None, None]
    c = K.SpamConfig(min_interval_ms=-1, burst_max_messages=0.5, duplicate_window_ms=True, burst_window_ms=2.9)
    assert (c.min_interval_ms, c.burst_max_messages, c.duplicate_window_ms, c.burst_window_ms) == (700, 6, 12000, 2)
    assert K.normalize_text("  Ａ \n\t b​c  " + "x" * 600) == ("a bc " + "x" * 600)[:511] and len(K.normalize_text("😀" * 400)) == 256


def messages(spark):
    import random

    r = random.Random(3)
    rows, now = [], 0
    for i in range(400):
        now += r.choice([10, 200, 500, 900, 4000])
        rows.append((i, r.choice(["a", "A ", "b", "c", None]), r.choice(["hi", "HI", "yo", "ok", ""]), float(now)))
    return rows, spark.createDataFrame(rows, "seq int, actor_key string, text string, now_ms double").repartition(3)


@pytest.mark.parametrize("tracked", [False, True])
def test_spam_tables_equal_the_fold(spark, tracked):
    rows, df = messages(spark)
    cfg = K.SpamConfig(duplicate_window_ms=3000, burst_max_messages=3, track_rejected_attempts=tracked)
    want = {r[0]: K.SpamGuard(cfg, store).check(r[1], r[2], r[3]) for store in [{}] for r in rows}
    got = lambda d: {r.seq: r.decision.reason for r in d.collect()}
    assert got(spam.decide(df, cfg)) == want
    assert got(spam.decide(df, cfg, exact_eviction=True)) == want
    if tracked:
        assert got(spam.decide_tracked(df, cfg)) == want


def test_spam_stream_equals_the_fold(spark, tmp_path):
    rows, df = messages(spark)
    cfg = K.SpamConfig(duplicate_window_ms=3000, burst_max_messages=3)
    want = {r[0]: K.SpamGuard(cfg, store).check(r[1], r[2], r[3]) for store in [{}] for r in rows}
    for k in range(3):  # three micro-batches in arrival order
        df.where(f"seq % 1 = 0 and seq between {k * 140} and {k * 140 + 139}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = guard_stream(source, cfg).writeStream.format("memory").queryName("decisions").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert {r.seq: r.reason for r in spark.table("decisions").collect()} == want


def test_profanity_columns(spark, texts):
    f = P.english_filter()
    d = texts.withColumn("m", ops.analyze("text", f))
    assert [len(r.m) for r in d.collect()] == [0, 0, 0, 0, 0, 2]
    assert d.select(F.sum(F.size(ops.filter_matches("m", categories=["OBSCENE_MAT"], min_severity="high"))), F.sum(F.size(ops.filter_matches("m", categories=[]))), F.sum(F.size(ops.of_mode("m", "strict")))).first() == (2, 0, 1)
    assert ops.match_rows(texts, "text", f).count() == 2 and ops.match_rows(texts, "text", f, outer=True).count() == 7
    assert ops.literal_hits(texts, "text", ops.vocabulary(spark, ["nothing", "call"]), ["text"]).count() == 2
    assert cached(texts, "text", "o", lambda c: ops.censor(c, f)).count() == 6


def test_sql_names(spark, texts):
    sql.register(spark)
    texts.createOrReplaceTempView("texts")
    row = spark.sql("select sum(size(scan_email(text))), sum(int(check_phone(text))), max(censor_url('go example.com')), max(spam_text(' A  b')) from texts").first()
    assert row == (1, 1, "go ***********", "a b")
    assert spark.sql("select rule_id, start from profanity_matches('fuck')").count() == 2
