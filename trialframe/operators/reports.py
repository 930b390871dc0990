"""Roll-ups of a run's problems and rounds. Groups overlap, so a row is dealt to its groups before one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import rate
from ..functions.scanners import report_metrics, scanned
from ..taxonomy import CATEGORIES, PRIMARIES, TARGETS

GROUPS = tuple(g for g, _, _ in TARGETS)


def pass_counts() -> list[Column]:
    """Size; passes at round 0 (by the round alone), by round 1 and by round 2."""
    ok, r = F.col("passed"), F.col("passed_round")
    return [F.count("*").alias("n"), F.count_if(r == 0).alias("r0"), F.count_if(ok & (r <= 1)).alias("r1"), F.count_if(ok & (r <= 2)).alias("r2")]


def groups(problems: DataFrame) -> DataFrame:
    """A row for each of the overlapping groups of a problem: benchmark, tier of the third benchmark (any case), overall."""
    tier = F.when((F.col("benchmark") == "appsplus") & F.lower("sub_tier").isin("introductory", "interview", "competition"), F.lower("sub_tier"))
    return problems.withColumn("grp", F.explode(F.array_compact(F.array(F.col("benchmark"), tier, F.lit("overall")))))


def pass_rates(problems: DataFrame) -> DataFrame:
    """R2: the counts of all groups, empty ones too, and their rates (null there)."""
    every = problems.sparkSession.createDataFrame([(g,) for g in GROUPS], "grp string")
    n = groups(problems).groupBy("grp").agg(*pass_counts())
    j = every.join(n, "grp", "left").na.fill(0, ["n", "r0", "r1", "r2"])
    return j.select("grp", "n", "r0", "r1", "r2", *(rate(r, "n").alias(f"pct_{r}") for r in ("r0", "r1", "r2")))


def deltas(problems: DataFrame, targets: tuple = TARGETS, named: bool = True) -> DataFrame:
    """Rate less published rate, only for a named model and a group of exactly the published size."""
    t = problems.sparkSession.createDataFrame(list(targets), "grp string, target double, size long")
    j = pass_rates(problems).join(t, "grp")
    shown = F.lit(named) & (F.col("n") == F.col("size"))
    return j.select("grp", "n", "target", F.when(shown, F.round(F.col("pct_r0") - F.col("target"), 1)).alias("delta_r0"), F.when(shown, F.round(F.col("pct_r2") - F.col("target"), 1)).alias("delta_r2"))


def bug_distribution(problems: DataFrame) -> DataFrame:
    """For each category: initial count, shares of failures and of all, unresolved at the end, fixed, resolution rate."""
    every = problems.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    # an initial and a final mark of each problem in one pass
    marks = problems.select("passed", "passed_round", F.explode(F.array(F.struct(F.col("initial_bug_sub").alias("category"), F.lit(True).alias("first")), F.struct(F.col("final_bug_sub").alias("category"), F.lit(False).alias("first")))).alias("m")).select("passed", "passed_round", "m.*")
    first = F.col("first")
    n = marks.groupBy("category").agg(F.count_if(first).alias("n_initial"), F.count_if(~first & ~F.col("passed")).alias("unresolved"), F.count_if(first & F.col("passed") & (F.col("passed_round") > 0)).alias("fixed"))
    totals = problems.agg(F.count("*").alias("n_all"), F.count_if(F.col("passed_round") != 0).alias("n_failing"))
    j = every.join(n, "category", "left").na.fill(0).join(F.broadcast(totals), F.lit(True))  # one row
    return j.select("category", "n_initial", rate("n_initial", "n_failing").alias("pct_failing"), rate("n_initial", "n_all").alias("pct_all"), "unresolved", "fixed", rate("fixed", "n_initial").alias("pct_resolved"))


def cohorts(problems: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """Repair rates of initially failing problems: all, by primary type, and a sample's ids where given; r1 is round 1 exactly, r2 up to 2."""
    failing = problems.filter("passed_round <> 0")
    if sample is not None:
        failing = failing.join(sample.select("task_id", F.lit(True).alias("sampled")), "task_id", "left")
    mark = F.when(F.col("sampled"), "sample") if sample is not None else F.lit(None).cast("string")
    dealt = failing.withColumn("cohort", F.explode(F.array_compact(F.array(F.lit("all"), mark, F.when(F.col("initial_bug_primary").isin(*PRIMARIES), F.concat(F.lit("type "), "initial_bug_primary"))))))
    ok, r = F.col("passed"), F.col("passed_round")
    n = dealt.groupBy("cohort").agg(F.count("*").alias("den"), F.count_if(ok & (r == 1)).alias("r1"), F.count_if(ok & (r <= 2)).alias("r2"))
    return n.select("cohort", "den", "r1", "r2", rate("r1", "den").alias("pct_r1"), rate("r2", "den").alias("pct_r2"))


def round_matrix(rounds: DataFrame) -> DataFrame:
    """Counts from round 0 to round 1; an unknown bug is Type B, a missing round 1 leaves the state; order Passed, A, B, C."""
    state = lambda p: F.when(F.col(f"{p}.passed"), "Passed").when(F.col(f"{p}.bug_primary").isin(*PRIMARIES), F.concat(F.lit("Type "), F.col(f"{p}.bug_primary"))).otherwise("Type B")
    j = rounds.filter("round_number = 0").alias("x").join(rounds.filter("round_number = 1").alias("y"), "task_id", "left")
    c = j.select(state("x").alias("from_state"), F.when(F.col("y.passed").isNull(), state("x")).otherwise(state("y")).alias("to_state"))
    names = ("Passed", "Type A", "Type B", "Type C")
    every = rounds.sparkSession.createDataFrame([(s,) for s in names], "from_state string")
    n = c.groupBy("from_state").agg(*(F.count_if(F.col("to_state") == s).alias(s.lower().replace(" ", "_")) for s in names))
    return every.join(n, "from_state", "left").na.fill(0)


#: Code metrics by name.
CODE_METRICS = (("loc", "Lines of Code (LOC)"), ("cc", "Cyclomatic Complexity (radon cc)"), ("calls", "API / Function Calls"), ("comments", "Comment Ratio (%)"))


def code_metrics(codes: DataFrame, key: str, code: str) -> DataFrame:
    """Key and loc, cc, calls and comments of each code that is not empty."""
    rows = codes.filter(F.length(code) > 0).select(F.col(key).alias("file_id"), F.col(code).alias("content"))
    return scanned(rows, lambda c: [report_metrics(c)], "loc long, cc double, calls long, comments double").withColumnRenamed("file_id", key)


def code_statistics(generated: DataFrame, canonical: DataFrame, key: str = "task_id") -> DataFrame:
    """A row for each code metric with its means over problems that have both codes, two places, 0 for none. ``generated`` and ``canonical`` are ``code_metrics``; each code is parsed once, before the join moves only four numbers of it."""
    both = generated.alias("g").join(canonical.alias("c"), key)
    means = both.agg(*(F.coalesce(F.round(F.avg(f"{side}.{m}"), 2), F.lit(0.0)).alias(f"{side}_{m}") for m, _ in CODE_METRICS for side in "gc"))
    rows = F.array(*(F.struct(F.lit(name).alias("metric"), F.col(f"g_{m}").alias("generated"), F.col(f"c_{m}").alias("canonical")) for m, name in CODE_METRICS))
    return means.select(F.explode(rows).alias("r")).select("r.*")


def report_tables(problems: DataFrame, rounds: DataFrame, generated: DataFrame, canonical: DataFrame, sample: DataFrame | None = None) -> dict[str, DataFrame]:
    """The six tables of a report by the names of their files."""
    return {
        "pass_rates": pass_rates(problems).join(deltas(problems).drop("n"), "grp", "left"), "bug_distribution": bug_distribution(problems), "repair_success_rate": cohorts(problems, sample),
        "bug_evolution_matrix": round_matrix(rounds), "code_statistics": code_statistics(generated, canonical), "token_and_cost_summary": tokens_and_time(problems, rounds),
    }


def tokens_and_time(problems: DataFrame, rounds: DataFrame) -> DataFrame:
    """Sums and means of tokens and durations over rounds of the problems, tokens per problem, seconds and minutes."""
    j = rounds.join(problems.select("task_id"), "task_id")
    a = j.agg(F.sum("token_count").alias("tokens"), F.avg("token_count").alias("avg_tokens"), F.sum("duration_ms").alias("ms"), F.avg("duration_ms").alias("avg_ms"), F.count_distinct("task_id").alias("problems"))
    return a.select("tokens", "avg_tokens", "ms", "avg_ms", (F.col("tokens") / F.col("problems")).alias("tokens_per_problem"), (F.col("ms") / 1000).alias("seconds"), (F.col("ms") / 60000).alias("minutes"))


def console_summary(problems: DataFrame) -> DataFrame:
    """Cumulative passes, repairs over initially failing ones."""
    r = F.col("passed_round")
    a = problems.agg(F.count("*").alias("total"), F.count_if(F.col("passed") & (r <= 0)).alias("r0"), F.count_if(F.col("passed") & (r <= 1)).alias("r1"), F.count_if(F.col("passed") & (r <= 2)).alias("r2"))
    return a.select("*", rate(F.col("r2") - F.col("r0"), F.col("total") - F.col("r0")).alias("pct_repaired"))


def bug_histogram(problems: DataFrame) -> DataFrame:
    return problems.filter("initial_bug_sub is not null").groupBy(F.col("initial_bug_sub").alias("bug")).agg(F.count("*").alias("n"))


def latest_run(runs: DataFrame, key: str = "started_at") -> DataFrame:
    """The newest run; TakeOrderedAndProject, not a sort."""
    return runs.orderBy(F.desc(key), F.desc("run_id")).limit(1)


def demo_candidates(problems: DataFrame) -> DataFrame:
    """Category and note of each problem for a demonstration."""
    ok, r = F.col("passed"), F.col("passed_round")
    kind = F.when(ok & (r == 0), "passes first try").when(ok & (r > 0), "fails, both modes fix").otherwise("unresolved")
    bug = F.coalesce("initial_bug_sub", "initial_bug_primary", F.lit("Bug"))
    note = F.when(ok & (r == 0), F.format_string("Initial generation passed all tests at Round 0 in %d ms.", F.col("total_duration_ms")))
    note = note.when(ok & (r > 0), F.format_string("Failed at Round 0 with %s, repaired successfully in Round %d.", bug, r)).otherwise(F.format_string("Failed Round 0 with %s, remained unresolved after iterations.", bug))
    return problems.select("task_id", kind.alias("category"), note.alias("note"))
