"""Raw text to validated, ordered transactions; everything rejected is kept with its reasons."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import columns as C
from riskloom.functions.columns import NA_TOKENS, null_tokens
from riskloom.operators.joins import assert_unique
from riskloom.operators.ordering import global_ordinal, ordinal_within
from riskloom.operators.schema import PROVENANCE, TYPED_ROLES, assign_roles, normalize_columns, typed_columns
from riskloom.session import stage

# Columns that make up the composed account ids of card data.
CARD_ID_COLUMNS = ("card1", "card2", "card3", "card5", "card6")
DESTINATION_ID_COLUMNS = ("type", "addr1", "addr2", "p_emaildomain", "r_emaildomain")


def join_side_table(tx: DataFrame, side: DataFrame, key: str = "transaction_id", check: bool = True) -> DataFrame:
    """LEFT join of the optional identity table; raises unless the key is unique on both sides."""
    if check:
        for name, frame in (("transaction", tx), ("identity", side)):
            if not assert_unique(frame, key).isEmpty():
                raise ValueError(f"{key} is not unique in the {name} table")
    return tx.join(side, key, "left")


def number_sources(df: DataFrame, order: Sequence[str], drop_order: bool = True) -> DataFrame:
    """Number the rows of each ``source_file`` from 1 in the given order: one range sort for all sources together."""
    ranked = ordinal_within(df, "source_file", order, "_row")
    row = F.col("_row")
    keep = [c for c in df.columns if c != "source_file" and not (drop_order and c in order)]
    return ranked.select(row.alias("source_row_number"), "source_file", row.alias("source_file_row_number"), *keep)


def union_sources(frames: Mapping[str, DataFrame], order: Sequence[str], drop_order: bool = True) -> DataFrame:
    """Union by name in source-name order; columns a source lacks are NULL. Headers are normalised."""
    if not frames:
        raise ValueError("at least one source is required")
    out = None
    for name in sorted(frames):
        frame = frames[name]
        payload = [c for c in frame.columns if c not in order]
        renamed = dict(zip(payload, normalize_columns(payload)))
        part = frame.toDF(*[renamed.get(c, c) for c in frame.columns]).withColumn("source_file", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return number_sources(out, order, drop_order)


def union_files(lines: DataFrame, source: Column | None = None, na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Rows of CSV files given as ``lines(line, _file, _block, _pos)``, numbered like those of :func:`union_sources`.

    The first line of each file is its header. Headers are data: a table says where each file has each column, and fields are taken by that
    place, so the plan is the same for any number of files; only the distinct headers come to the driver. ``source`` names a row's source by
    its ``_file`` (the file's name if not given). Fields hold no line breaks. A file of a header alone, or of nothing, has no rows.
    """
    path = F.split("_file", "/")
    name = F.element_at(path, -1) if source is None else source
    heads = lines.where("_block = 0").groupBy("_file").agg(F.min_by("line", "_pos").alias("header"), F.min("_pos").alias("_head"))
    heads = stage(heads.withColumn("source_file", name), "headers")
    variants = heads.groupBy("header").agg(F.min("source_file").alias("first")).orderBy("first", "header").collect()
    names = {r["header"]: normalize_columns(next(csv.reader([r["header"]], escapechar="\\"))) for r in variants}
    columns = list(dict.fromkeys(c for each in names.values() for c in each))
    if not columns:
        raise ValueError("at least one source is required")
    width = max(map(len, names.values()))
    places = [(h, [each.index(c) if c in each else -1 for c in columns]) for h, each in names.items()]
    # Staged: the planner sees the table's size, not the product of the two.
    table = stage(heads.join(F.broadcast(lines.sparkSession.createDataFrame(places, "header string, _at array<int>")), "header").drop("header"), "places")
    rows = lines.join(table, "_file").where((F.col("_block") > 0) | (F.col("_pos") > F.col("_head")))
    fields = F.from_csv("line", ", ".join(f"c{i} string" for i in range(width)), {"escape": "\\"})
    split = rows.withColumn("_fields", F.array(*[fields[f"c{i}"] for i in range(width)]))
    value = lambda i: F.when(F.get("_at", F.lit(i)) >= 0, F.get("_fields", F.get("_at", F.lit(i))))
    placed = split.select("source_file", "_file", "_block", "_pos", *[null_tokens(value(i), na_tokens).alias(c) for i, c in enumerate(columns)])
    return number_sources(placed, ["_file", "_block", "_pos"])


def trim_all(df: DataFrame, skip: Sequence[str] = PROVENANCE) -> DataFrame:
    """Strip every text column in one projection."""
    return df.select(*[
        F.trim(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) and f.name not in skip else F.col(f.name)
        for f in df.schema.fields
    ])


def canonicalize(df: DataFrame) -> DataFrame:
    """Map card-style columns to the canonical names; other tables pass unchanged."""
    if not {"transaction_id", "is_fraud", "transaction_dt"} <= set(df.columns):
        return df
    renames = {"transaction_amt": "amount", "product_cd": "type"}
    df = df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})
    if "step" not in df.columns:
        df = df.withColumn("step", C.coerce_integer("transaction_dt"))
    if "transaction_timestamp" not in df.columns:
        df = df.withColumn("transaction_timestamp", C.offset_to_timestamp(C.coerce_numeric("step")))
    extra = {}
    for name, parts in (("name_orig", CARD_ID_COLUMNS), ("name_dest", DESTINATION_ID_COLUMNS)):
        if name not in df.columns:
            extra[name] = C.compose_entity_id([p for p in parts if p in df.columns], "transaction_id")
    if "is_flagged_fraud" not in df.columns:
        extra["is_flagged_fraud"] = F.lit(False)
    return df.withColumns(extra)


#: A row number takes the lower 19 decimal digits, which hold any 64-bit number.
ROW_DIGITS = 10**19


def dedupe_exact_keep_first(df: DataFrame, order: Sequence[str] = ("source_file", "source_file_row_number"), ignore: Sequence[str] = PROVENANCE, sources: Sequence[str] | None = None) -> DataFrame:
    """Keep the first of rows equal in every payload column (NULL equals NULL).

    A grouped minimum of the provenance: copies collapse before the shuffle, so a group of
    copies that makes up most of the table is no hot spot. With the ordered list of ``sources`` the
    first file and row are one decimal number and the aggregation hashes; otherwise Spark has to sort the groups.
    The row number within the table is expected to be that within the file, as :func:`union_sources` gives it.
    """
    payload = [c for c in df.columns if c not in ignore]
    provenance = [c for c in df.columns if c in ignore]
    if sources is None:
        first = F.min_by(F.struct(*provenance), F.struct(*order)).alias("_first")
        return df.groupBy(*payload).agg(first).select(*payload, "_first.*").select(*df.columns)
    wide = "decimal(38,0)"
    place = F.create_map(*[x for i, s in enumerate(sources) for x in (F.lit(s), F.lit(i))])[F.col("source_file")]
    packed = (place.cast("decimal(10,0)") * F.lit(str(ROW_DIGITS)).cast("decimal(20,0)")).cast(wide) + F.col("source_file_row_number").cast("decimal(19,0)")
    distinct = df.groupBy(*payload).agg(F.min(packed.cast(wide)).alias("_first"))
    row = (F.col("_first") % F.lit(str(ROW_DIGITS)).cast("decimal(20,0)")).cast("bigint")
    at = F.floor(F.col("_first") / F.lit(str(ROW_DIGITS)).cast("decimal(20,0)")).cast("int")
    names = F.array(*[F.lit(s) for s in sources])
    unpacked = {"source_file": F.get(names, at), "source_row_number": row, "source_file_row_number": row}
    return distinct.select(*[unpacked[c].alias(c) if c in unpacked else F.col(c) for c in df.columns])


Roles = Mapping[str, Sequence[str]]


def coerce_frame(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """Typed columns plus one ``invalid_<column>`` flag for each of them, in one projection."""
    roles = roles or assign_roles(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    rules = {
        "number": (C.coerce_numeric, T.DoubleType), "whole": (C.coerce_integer, T.LongType),
        "flag": (C.coerce_boolean, T.BooleanType), "time": (C.coerce_timestamp, T.TimestampType),
    }
    typed = {}
    for role in TYPED_ROLES:
        rule, ready = rules[role]
        for name in roles[role]:
            typed[name] = F.col(name) if isinstance(types[name], ready) else rule(name)
    values = [typed[c].alias(c) if c in typed else F.col(c) for c in df.columns]
    flags = [C.parse_failure(F.col(c), e).alias(f"invalid_{c}") for c, e in typed.items()]
    return df.select(*values, *flags)


def reject_reasons(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """Append ``reasons array<string>``; expects the flags of :func:`coerce_frame`."""
    roles = roles or assign_roles([c for c in df.columns if not c.startswith("invalid_")])
    typed = typed_columns(roles)
    checks = {f"invalid_{c}": F.col(f"invalid_{c}") for c in typed if f"invalid_{c}" in df.columns}
    bad_balance = [checks[f"invalid_{c}"] for c in roles["balance"] if f"invalid_{c}" in checks]
    if roles["key"]:
        checks["missing_required_id"] = C.missing_required(roles["key"])
    if "amount" in df.columns:
        checks["negative_amount"] = C.negative_value("amount")
    typed_balances = [c for c in roles["balance"] if c in typed]
    if typed_balances:
        checks["negative_balance"] = C.negative_any(typed_balances)
    if bad_balance:
        checks["malformed_balance"] = C.any_of(bad_balance)
    named = F.array(*[F.when(cond, F.lit(name)) for name, cond in checks.items()])
    return df.withColumn("reasons", F.filter(named, lambda r: r.isNotNull()))


def count_reasons(df: DataFrame) -> DataFrame:
    return df.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected) by the reasons column."""
    flags = [c for c in df.columns if c.startswith("invalid_")]
    clean = df.where(F.size("reasons") == 0).drop("reasons", *flags)
    return clean, df.where(F.size("reasons") > 0).drop(*flags)


def assign_transaction_order(df: DataFrame, roles: Roles | None = None, out: str = "transaction_order") -> DataFrame:
    """Number the transactions by time (else step), then source; NULL times come last."""
    roles = roles or assign_roles(df.columns)
    order = []
    times = [c for c in roles["sequence"] if "timestamp" in c]
    if times:
        df = df.withColumnRenamed(times[0], "transaction_timestamp")
        order.append("transaction_timestamp")
    elif "step" in df.columns:
        order.append("step")
    order += [c for c in ("source_file", "source_file_row_number", "source_row_number") if c in df.columns]
    return global_ordinal(df, order, out)


@dataclass(frozen=True)
class CleanResult:
    clean: DataFrame
    rejected: DataFrame
    report: DataFrame


def flagged_transactions(frames: Mapping[str, DataFrame], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(all rows as trimmed text, distinct rows typed with reasons)."""
    raw = canonicalize(trim_all(union_sources(frames, order)))
    # Duplicates are recognised on the trimmed text, before any typing.
    return raw, reject_reasons(coerce_frame(dedupe_exact_keep_first(raw, sources=sorted(frames))))


def clean_files(lines: DataFrame, source: Column | None = None) -> CleanResult:
    """:func:`clean_transactions` over the lines of any number of CSV files, in one plan."""
    raw = canonicalize(trim_all(stage(union_files(lines, source), "united")))
    return _cleaned(raw, reject_reasons(coerce_frame(dedupe_exact_keep_first(raw))))


def clean_transactions(frames: Mapping[str, DataFrame], order: Sequence[str]) -> CleanResult:
    """Union, dedupe, type, validate and order raw text sources."""
    return _cleaned(*flagged_transactions(frames, order))


def _cleaned(raw: DataFrame, flagged: DataFrame) -> CleanResult:
    """The flagged table is staged once because three outputs read it."""
    flagged = stage(flagged, "flagged")
    clean, rejected = quarantine(flagged)
    ordered = assign_transaction_order(clean)
    return CleanResult(ordered, rejected, cleaning_report(raw, flagged, ordered.columns))


def cleaning_report(raw: DataFrame, flagged: DataFrame, columns_out: Sequence[str]) -> DataFrame:
    """One row: rows in and out, per-source counts, duplicates and rejects by reason."""
    sources = raw.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    as_map = lambda name: F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "n"))))
    rows_in = sources.agg(F.sum("n").alias("rows_in"), as_map("source_file").alias("input_row_counts"))
    kept = flagged.agg(
        F.count(F.lit(1)).alias("_distinct"), F.count_if(F.size("reasons") > 0).alias("invalid_rows_dropped")
    )
    reasons = count_reasons(flagged).agg(as_map("reason").alias("drop_reasons"))
    # Three one-row aggregates side by side.
    one = F.lit(1).alias("_one")
    joined = rows_in.select("*", one).join(kept.select("*", one), "_one").join(reasons.select("*", one), "_one")
    return joined.select(
        "rows_in",
        "input_row_counts",
        (F.col("rows_in") - F.col("_distinct")).alias("duplicate_rows_dropped"),
        "invalid_rows_dropped",
        (F.col("_distinct") - F.col("invalid_rows_dropped")).alias("rows_out"),
        "drop_reasons",
        F.array(*[F.lit(c) for c in columns_out]).alias("columns_out"),
    )
