"""Metrics of repair trajectories.

Outcomes have ``task_id`` and ``states`` (array): the state after iteration 0, 1, ..., with
PASS absorbing; a shorter array carries its last state forward. Everything is one pass
over the exploded steps, aggregated by iteration (a handful of groups, pre-aggregated), so
no shuffle grows with the number of programs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import rate
from ..taxonomy import CATEGORIES, PRIMARIES, STATES, UNMAPPED, priority


def outcomes(steps: DataFrame) -> DataFrame:
    """task_id and its states in order, from one row per (task_id, i, state)."""
    return steps.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "state"))), lambda s: s["state"]).alias("states"))


def state_at(i: Column | int, states: Column | str = "states") -> Column:
    """The state after iteration i, carried forward."""
    states = F.col(states) if isinstance(states, str) else states
    i = F.lit(i) if isinstance(i, int) else i
    return F.element_at(states, F.least(i.cast("int") + 1, F.size(states)))


def tall(failing: DataFrame, k: int) -> DataFrame:
    """task_id, i, from and to for i = 1..k."""
    steps = failing.select("task_id", "states", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("i"))
    return steps.select("task_id", F.col("i").cast("long").alias("i"), state_at(F.col("i") - 1).alias("from_state"), state_at(F.col("i")).alias("to_state"))


def initially_failing(every: DataFrame) -> DataFrame:
    return every.filter(F.col("states")[0] != "PASS")


def rsr(t: DataFrame) -> DataFrame:
    """M2: programs that passed by iteration i, over all."""
    n = t.groupBy("i").agg(F.count_if(F.col("to_state") == "PASS").alias("num"), F.count("*").alias("den"))
    return n.select("i", "num", "den", rate("num", "den").alias("pct"))


def conditional(t: DataFrame) -> DataFrame:
    """M3: programs that passed at i over those that had not by i - 1; from the second iteration on."""
    n = t.filter("i >= 2").groupBy("i").agg(F.count_if((F.col("from_state") != "PASS") & (F.col("to_state") == "PASS")).alias("num"), F.count_if(F.col("from_state") != "PASS").alias("den"))
    return n.select("i", "num", "den", rate("num", "den").alias("pct"))


def per_primary(t: DataFrame, k: int) -> DataFrame:
    """M4: of the programs in each failing state before i, those that pass at i; states without programs have null."""
    spark = t.sparkSession
    frame = spark.createDataFrame([(i, p) for i in range(1, k + 1) for p in PRIMARIES], "i long, from_state string")
    n = t.groupBy("i", "from_state").agg(F.count_if(F.col("to_state") == "PASS").alias("num"), F.count("*").alias("den"))
    j = frame.join(n, ["i", "from_state"], "left").select("i", "from_state", F.coalesce("num", F.lit(0)).alias("num"), F.coalesce("den", F.lit(0)).alias("den"))
    return j.withColumn("pct", rate("num", "den"))


def per_category(labelled: DataFrame, k: int) -> DataFrame:
    """M5: of each initial category, all present, the programs repaired within k. ``labelled`` also has initial_category; an unknown one is an error."""
    given = F.coalesce("initial_category", F.lit(UNMAPPED))
    named = labelled.select(F.when(given.isin(*CATEGORIES, UNMAPPED), given).otherwise(F.raise_error(F.concat(F.lit("unknown category "), "initial_category"))).alias("category"), (state_at(k) == "PASS").alias("repaired"))
    n = named.groupBy("category").agg(F.count_if("repaired").alias("num"), F.count("*").alias("den"))
    every = labelled.sparkSession.createDataFrame([(c, priority(c)) for c in (*CATEGORIES, UNMAPPED)], "category string, priority long")
    j = every.join(n, "category", "left").select("category", "priority", F.coalesce("num", F.lit(0)).alias("num"), F.coalesce("den", F.lit(0)).alias("den"))
    return j.withColumn("pct", rate("num", "den"))


def evolution(t: DataFrame, k: int) -> DataFrame:
    """M6: for each iteration a row per state before it: counts of states after it, their total and unrounded percentages (null for an empty row)."""
    frame = t.sparkSession.createDataFrame([(i, s) for i in range(1, k + 1) for s in STATES], "i long, from_state string")
    n = t.groupBy("i", "from_state").agg(*(F.count_if(F.col("to_state") == s).alias(f"to_{s.lower()}") for s in STATES), F.count("*").alias("total"))
    names = [*(f"to_{s.lower()}" for s in STATES), "total"]
    j = frame.join(n, ["i", "from_state"], "left").select("i", "from_state", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))
    return j.select("*", *((F.lit(100.0) * F.col(f"to_{s.lower()}") / F.nullif(F.col("total"), F.lit(0))).alias(f"pct_{s.lower()}") for s in STATES))


def unmapped(flags: DataFrame, k: int) -> DataFrame:
    """M7: flagged candidates at each iteration 0..k, not carried forward; ``flags`` has an array unmapped_as_c."""
    every = flags.sparkSession.range(k + 1).select(F.col("id").alias("i"))
    n = flags.select(F.posexplode("unmapped_as_c").alias("i", "flag")).groupBy("i").agg(F.count_if("flag").alias("n"))
    return every.join(n.select(F.col("i").cast("long").alias("i"), "n"), "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"))


def pass_at_one(entries: DataFrame, sample: DataFrame, k: int) -> DataFrame:
    """Entries (task_id, passed) with the repaired flag of those in the sample: passes before and after over all entries."""
    repaired = sample.select("task_id", (state_at(k) == "PASS").alias("repaired"))
    j = entries.join(repaired, "task_id", "left").agg(F.count_if("passed").alias("before"), F.count_if(F.coalesce("repaired", "passed")).alias("after"), F.count("*").alias("n"))
    return j.select("before", "after", "n", rate("before", "n").alias("pct_before"), rate("after", "n").alias("pct_after"))


def cost(calls: DataFrame, programs: int) -> DataFrame:
    """M9: repair calls, those without usage, and tokens: null if there are calls and all lack usage; per program null for none."""
    missing = F.col("prompt_tokens").isNull() & F.col("completion_tokens").isNull()
    c = calls.filter("phase = 'repair'").agg(F.count("*").alias("calls"), F.count_if(missing).alias("without_usage"), F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("q"))
    none = (F.col("calls") > 0) & (F.col("calls") == F.col("without_usage"))
    tokens = lambda x: F.when(~none, F.coalesce(F.col(x), F.lit(0)).cast("long"))
    per = lambda x: x.cast("double") / F.nullif(F.lit(programs), F.lit(0))
    return c.select("calls", "without_usage", tokens("p").alias("prompt_tokens"), tokens("q").alias("completion_tokens"), per(F.col("calls")).alias("calls_per_program"))


def with_defaults(calls: DataFrame) -> DataFrame:
    """Missing tokens count as zero; the total is the reported one or the sum."""
    p, q = F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("completion_tokens", F.lit(0))
    total = F.col("total_tokens") if "total_tokens" in calls.columns else F.lit(None).cast("long")
    return calls.withColumn("prompt_tokens", p).withColumn("completion_tokens", q).withColumn("total", F.coalesce(total, p + q))


def summary(t: DataFrame, calls: DataFrame, k: int, programs: int) -> DataFrame:
    """M2, M3, M6 and M9 as one row of nested arrays and its JSON."""
    tables = {"rsr": rsr(t), "conditional": conditional(t), "evolution": evolution(t, k), "cost": cost(calls, programs)}
    out = None
    for name, table in tables.items():
        one = table.agg(F.array_sort(F.collect_list(F.struct(*table.columns))).alias(name)).withColumn("one", F.lit(1))
        out = one if out is None else out.join(one, "one")
    return out.drop("one").withColumn("json", F.to_json(F.struct(*tables)))


def violations(every: DataFrame, known: tuple[str, ...] = STATES) -> DataFrame:
    """task_id and the first rule that its outcome breaks: empty, unknown, initial_pass, not_absorbing."""
    s = F.col("states")
    first = F.array_position(s, "PASS").cast("int")
    rule = (
        F.when(F.size(s) == 0, "empty")
        .when(~F.forall(s, lambda x: x.isin(*known)), "unknown")
        .when(F.get(s, F.lit(0)) == "PASS", "initial_pass")
        .when((first > 0) & F.exists(F.slice(s, F.greatest(first, F.lit(1)), F.size(s)), lambda x: x != "PASS"), "not_absorbing")
    )
    return every.select("task_id", rule.alias("rule")).filter("rule is not null")


def passed_by(gates: DataFrame) -> DataFrame:
    """Whether a program has passed at or before each of its iterations."""
    w = Window.partitionBy("task_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return gates.select("task_id", "i", F.max("passed").over(w).alias("passed_by"))


def transitions(checks: DataFrame) -> DataFrame:
    """From the last available state to the state of each iteration from 1 on; an incomplete check (null state) is not available and does not advance the chain; none if the program passes at 0."""
    w = Window.partitionBy("task_id").orderBy("i")
    before = F.last("state", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("state").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = checks.select("task_id", "i", before.alias("from_state"), F.col("state").alias("to_state"), F.col("state").isNotNull().alias("available"), first.alias("first_state"))
    return t.filter("i > 0 and not (first_state <=> 'PASS')").drop("first_state")


def repair_result(gates: DataFrame) -> DataFrame:
    """not_applicable for a pass at 0, else by the gate of the last iteration."""
    g = gates.groupBy("task_id").agg(F.max_by("passed", "i").alias("last"), F.min_by("passed", "i").alias("first"))
    return g.select("task_id", F.when(F.col("first"), "not_applicable").when(F.col("last"), "repaired").otherwise("not_repaired").alias("result"))


def gates(reports: DataFrame, techniques: tuple[str, ...]) -> DataFrame:
    """Complete if every correctness technique is present and complete; the gate also needs no correctness finding. ``reports``: report_id, complete map<string,boolean>, n_findings."""
    whole = F.forall(F.array(*(F.lit(t) for t in techniques)), lambda t: F.coalesce(F.try_element_at(F.col("complete"), t), F.lit(False)))
    return reports.select("report_id", whole.alias("is_complete"), (whole & (F.col("n_findings") == 0)).alias("gate"))


def best_category(findings: DataFrame, key: str) -> DataFrame:
    """The category of highest priority of each key, and the state it gives (C, flagged, for unmapped only)."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(c) for c in CATEGORIES)), F.col("category")).cast("long"), F.lit(0))
    rank = F.when(rank > 0, rank).otherwise(len(CATEGORIES) + 1)
    g = findings.groupBy(key).agg(F.min(rank).alias("priority"))
    name = F.coalesce(F.get(F.array(*(F.lit(c) for c in CATEGORIES)), F.col("priority").cast("int") - 1), F.lit(UNMAPPED))
    return g.select(key, name.alias("category"), F.when(name == UNMAPPED, "C").otherwise(F.substring(name, 1, 1)).alias("state"), (name == UNMAPPED).alias("unmapped_as_c"))


def evolution_points(checks: DataFrame) -> DataFrame:
    """Iteration and index of the state in A, B, C, PASS; null where unavailable."""
    index = F.array_position(F.array(*(F.lit(s) for s in STATES)), F.col("state")) - 1
    return checks.select("task_id", "i", F.when(F.col("state").isNotNull(), index).alias("level"))


def legacy_summary(tasks: DataFrame) -> DataFrame:
    """Tasks (task_id, category, repaired), several rows a task: per category distinct repaired tasks over all occurrences, to 3 places."""
    g = tasks.groupBy("category").agg(F.count_distinct(F.when(F.col("repaired"), F.col("task_id"))).alias("num"), F.count("*").alias("den"))
    return g.withColumn("share", F.floor(F.lit(1000.0) * F.col("num") / F.col("den") + 0.5) / 1000.0)
