"""A cascade of gates over an append-only log of attempts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import scalar as S
from corpusloom.operators.relational import latest

ATTEMPT = "uid string, gate string, status string, passed boolean, attempt_id long"
# Names of the seven types.
METHODS = ("choropleth", "diagrams", "dot_density", "isolines", "cartogram", "flow_map", "heat_map")


def size_gate(width: Column, height: Column, least: int = 400) -> Column:
    """Null sides fail."""
    return F.coalesce(S.least_strict(width, height) >= least, F.lit(False))


def repaired_quantitative(statistical: Column, quantitative: Column) -> Column:
    """What is not statistical is not quantitative."""
    return F.when(~statistical, F.lit(False)).otherwise(quantitative)


def data_level(statistical: Column, quantitative: Column) -> Column:
    return F.when(~statistical, "not_applicable").when(quantitative, "quantitative").otherwise("non_quantitative")


def methods_count(flags: dict[str, Column]) -> Column:
    return sum((F.coalesce(c.cast("int"), F.lit(0)) for c in flags.values()), F.lit(0))


def type_rule(flags: dict[str, Column], classed: Column) -> tuple[Column, Column, Column]:
    """(f2, f3, passed): some type; a choropleth has a classed legend; both.  Nulls count as false."""
    f2 = methods_count(flags) > 0
    f3 = F.coalesce(~flags["choropleth"] | classed, F.lit(False))
    return f2, f3, f2 & f3


def pending(scope: DataFrame, log: DataFrame, gate: str) -> DataFrame:
    """Items whose latest attempt at a gate is missing or not done."""
    done = latest(log.filter(F.col("gate") == gate), ["uid", "gate"], "attempt_id").filter("status = 'done'")
    return scope.join(done.select("uid"), "uid", "left_anti")


def valid_reply(body: Column, flags: tuple[str, ...], strings: tuple[str, ...] = (), choices: dict[str, tuple[str, ...]] | None = None, maybe: tuple[str, ...] = ()) -> Column:
    """Whether a JSON object has all fields with real types: booleans, strings, strings of a choice, booleans or null."""
    v = F.try_parse_json(body)
    kind = lambda n: F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant"))
    text = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    checks = [kind(n) == "BOOLEAN" for n in flags] + [kind(n) == "STRING" for n in strings]
    checks += [(kind(n) == "STRING") & text(n).isin(*values) for n, values in (choices or {}).items()]
    checks += [kind(n).isin("BOOLEAN", "VOID") for n in maybe]
    return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), checks, F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))


def corpus_rule(prefix: str = "") -> Column:
    """The nine conditions of the corpus; nulls count as false."""
    c = lambda n: F.col(f"{prefix}{n}")
    flags = [c(n) for n in ("is_map", "is_map_dominant", "is_statistical_map", "has_admin_units", "has_quantitative_data")]
    every = [c("size_status") == "pass", c("step3_status") == "done", c("methods_count") >= 1, c("map_language") == "en", *flags]
    return F.coalesce(reduce(lambda a, b: a & b, every), F.lit(False))


def subset_rule(prefix: str = "") -> Column:
    """The stricter subset: passed the last step, and the conditions of size, language and flags."""
    c = lambda n: F.col(f"{prefix}{n}")
    flags = [c(n) for n in ("is_map", "is_map_dominant", "is_statistical_map", "has_admin_units", "has_quantitative_data")]
    return F.coalesce(reduce(lambda a, b: a & b, [c("step4_passed"), c("size_status") == "pass", c("map_language") == "en", *flags]), F.lit(False))


def in_scope(items: DataFrame, everything: bool = False, uids: list[str] | None = None, pilot: int | None = None) -> DataFrame:
    """All items, those with given uids, or the first few by uid: exactly one of the three."""
    if (everything, uids is not None, pilot is not None).count(True) != 1:
        raise ValueError("exactly one of everything, uids and pilot")
    if uids is not None:
        return items.join(items.sparkSession.createDataFrame([(u,) for u in uids], "uid string"), "uid", "left_semi")
    return items if pilot is None else items.orderBy("uid").limit(pilot)


def run_gates(items: DataFrame, attempts: DataFrame, gates: list[tuple[str, Callable[[DataFrame], DataFrame]]], save: Callable[[DataFrame], DataFrame], stop_after: str | None = None, force: bool = False) -> DataFrame:
    """Walk the gates in order; each gets only items that passed all before and have no final attempt yet.

    A gate maps items to (uid, status, passed).  ``save`` stores a log and returns it read back, so a gate is run
    once; running all again changes nothing.  ``force`` runs gates again whatever the log has; no gate after
    ``stop_after`` is run.  Further columns of ``attempts`` (token counts) are filled where a gate gives them.
    """
    log, scope = attempts, items
    for name, gate in gates:
        todo = scope if force else pending(scope, log, name)
        given = gate(todo)
        more = [c for c in attempts.columns if c not in ("uid", "gate", "status", "passed", "attempt_id") and c in given.columns]
        answers = given.select("uid", F.lit(name).alias("gate"), "status", "passed", *more)
        start = log.agg(F.coalesce(F.max("attempt_id"), F.lit(0))).first()[0] + 1
        log = save(log.unionByName(answers.withColumn("attempt_id", F.lit(start).cast("long")), allowMissingColumns=True))
        passed = latest(log.filter(F.col("gate") == name), ["uid", "gate"], "attempt_id").filter("status = 'done' and passed")
        scope = scope.join(passed.select("uid"), "uid", "left_semi")
        if name == stop_after:
            break
    return log


def gate_counters(log: DataFrame, tokens: tuple[str, ...] = ()) -> DataFrame:
    """gate, n, done, passed, failed, errors of each gate's latest attempts, and sums of ``tokens`` over all attempts."""
    last = latest(log.select("uid", "gate", "status", "passed", "attempt_id"), ["uid", "gate"], "attempt_id")
    done = F.col("status") == "done"
    counts = last.groupBy("gate").agg(F.count("*").alias("n"), F.count_if(done).alias("done"), F.count_if(done & F.col("passed")).alias("passed"), F.count_if(done & ~F.col("passed")).alias("failed"), F.count_if(~done).alias("errors"))
    return counts.join(log.groupBy("gate").agg(*(F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in tokens)), "gate") if tokens else counts


def connect(requests: DataFrame, call: Callable[[dict], dict], answer: str, attempts: int = 3, delay: float = 0.0) -> DataFrame:
    """Each request's answer from an outside service, in Arrow batches: columns ``answer`` (a schema, as DDL), ``status``
    (done, parse_error, error), ``attempts`` and ``error``.

    ``call`` takes a request as a dict.  A ValueError is a reply that can't be read; both it and other errors are tried
    again; after a limit was hit (429, 529, overloaded) the wait grows with each attempt.
    """
    import pandas as pd
    from pyspark.sql import types as T

    names = T._parse_datatype_string(answer).names if isinstance(answer, str) else answer.names

    def run(batches):
        import time

        for pdf in batches:
            rows = []
            for request in pdf.to_dict("records"):
                got, status, error, n = {}, "error", None, 0
                while n < attempts:
                    n += 1
                    try:
                        got, status, error = call(request), "done", None
                        break
                    except ValueError as e:
                        status, error = "parse_error", f"parse: {e}"
                        wait = delay
                    except Exception as e:
                        status, error = "error", str(e)
                        limited = any(x in error.lower() for x in ("rate_limit", "429", "overloaded", "529"))
                        wait = delay * n * 2 if limited else delay
                    if n < attempts:
                        time.sleep(wait)
                rows.append([*(got.get(k) for k in names), status, n, error])
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=[*names, "status", "attempts", "error"])], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInPandas(run, f"{kept}, {answer}, status string, attempts int, error string")
