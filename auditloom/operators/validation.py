"""Validation in stages: rules as a table, compiled to one expression, later stages only where the earlier ones passed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "struct<stage: string, rule: string, message: string>"


@dataclass(frozen=True)
class Rule:
    """A rule of a stage: a row passes if ``holds`` is true. message: what is wrong otherwise, as a text or Column.

    A rule that cannot be evaluated (null) has failed, with a message that says so.
    """

    stage: str
    name: str
    holds: Column
    message: Column | str = ""


def validate(rows: DataFrame, rules: Sequence[Rule], fail_fast: bool = True) -> DataFrame:
    """rows with is_valid, stages (those that were done) and errors (stage, rule, message).

    Stages come in the order of their first rule. With fail_fast a row is not looked at in later stages once one has an error, and
    its stages end with that one; else all stages are done. One projection, whatever the number of rules: no shuffle.
    """
    stages = list(dict.fromkeys(r.stage for r in rules))
    none = F.array().cast(f"array<{ERROR}>")

    def error(rule: Rule) -> Column:
        text = F.lit(rule.message) if isinstance(rule.message, str) else rule.message
        entry = lambda m: F.struct(F.lit(rule.stage).alias("stage"), F.lit(rule.name).alias("rule"), m.alias("message"))
        return F.when(rule.holds.isNull(), entry(F.lit(f"rule {rule.name} could not be applied"))).when(~rule.holds, entry(F.coalesce(text, F.lit(""))))

    out, errors, done = rows, none, F.array().cast("array<string>")
    for k, stage in enumerate(stages):
        own = F.array_compact(F.array(*[error(r) for r in rules if r.stage == stage])).cast(f"array<{ERROR}>")
        reached = F.lit(True) if not k or not fail_fast else F.size(f"_errors{k - 1}") == 0
        out = out.withColumn(f"_errors{k}", F.when(reached, F.concat(F.col(f"_errors{k - 1}") if k else none, own)).otherwise(F.col(f"_errors{k - 1}") if k else none))
        done = F.when(reached, F.concat(done, F.array(F.lit(stage)))).otherwise(done)
        errors = F.col(f"_errors{k}")
    return out.withColumn("is_valid", F.size(errors) == 0).withColumn("stages", done).withColumn("errors", errors).drop(*[f"_errors{k}" for k in range(len(stages))])


def in_batches(validated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What validate has left, in totals (by some columns): rows, valid ones, errors, and the share of valid ones in percent."""
    totals = [F.count("*").alias("n_rows"), F.count_if("is_valid").alias("n_valid"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("long").alias("n_errors")]
    return validated.groupBy(*by).agg(*totals).withColumn("percent_valid", F.round(F.try_divide(100.0 * F.col("n_valid"), F.col("n_rows")), 2))


def error_counts(validated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Errors by stage and rule (and some columns)."""
    return validated.select(*by, F.explode("errors").alias("e")).groupBy(*by, "e.stage", "e.rule").agg(F.count("*").alias("n"))


def extraction_rules(length: Column, text: Column, n_files: Column, suffixes: Sequence[str], name: Column) -> list[Rule]:
    """Checks of an extracted package: there, not empty, of a known kind, and readable as text."""
    known = reduce(lambda a, b: a | b, [F.lower(name).endswith(s) for s in suffixes])
    return [
        Rule("exists", "length_known", length.isNotNull(), "no such file"),
        Rule("exists", "some_files", n_files > 0, "nothing was extracted"),
        Rule("contents", "not_empty", length > 0, "empty file"),
        Rule("contents", "known_kind", known, F.concat(F.lit("unknown kind of file "), name)),
        Rule("text", "readable", ~text.contains("\ufffd"), "not in UTF-8"),
    ]
