"""Relationships between parties: foreign keys, composites, bridges, one row's roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.functions import values
from kinweave.operators.bronze import union
from kinweave.operators.metadata import Metadata
from kinweave.sources.tables import Sources, current


def main_parties(parties: DataFrame, table_id: str, main_type: str | None) -> DataFrame:
    """One party per record of a table: (record, party_id).

    Tables with a main party type stand for it; others have one party per row.
    Of several the smallest id counts.
    """
    own = current(parties).filter(F.col("system_table_id") == table_id)
    if main_type is not None:
        own = own.filter(F.col("party_type_id") == main_type)
    return own.groupBy(F.col("source_record_id").alias("record")).agg(F.min("source_party_id").alias("party_id"))


def _edge(df: DataFrame, relationship_id: str, at: Column, from_value: str = "from_value", to_value: str = "to_value") -> DataFrame:
    return df.select(
        values.relationship_id("FK", F.col("from_party"), F.col("to_party")).alias("party_relationship_id"),
        F.lit(relationship_id).alias("metadata_relationship_id"),
        F.lit(None).cast("string").alias("metadata_party_type_relationship_id"),
        F.col("from_party").alias("from_party_id"),
        F.col("to_party").alias("to_party_id"),
        F.col(from_value).alias("from_matching_value"),
        F.col(to_value).alias("to_matching_value"),
        at.alias("rec_start_date"),
        F.lit(None).cast("timestamp").alias("rec_end_date"),
    ).distinct()


def _keyed(rows: DataFrame, key: str, columns: list[str], side: str, parties: DataFrame) -> DataFrame:
    """(value, record) of rows with no null key part, joined with the record's party."""
    value = F.concat_ws("|", *[values.text(F.col(c)) for c in columns])
    given = rows.filter(F.expr(" and ".join(f"`{c}` is not null" for c in columns)))
    keyed = given.select(value.alias("value"), *[values.text(F.col(c)).alias(f"k{i}") for i, c in enumerate(columns)], values.text(F.col(key)).alias("record"))
    return keyed.join(parties, "record").select("value", *[f"k{i}" for i in range(len(columns))], F.col("party_id").alias(f"{side}_party"))


def foreign_key(from_rows: DataFrame, to_rows: DataFrame, from_key: str, to_key: str, from_columns: list[str], to_columns: list[str], from_parties: DataFrame, to_parties: DataFrame, relationship_id: str, at: Column) -> DataFrame:
    """Edges where the from columns equal the to columns; one or several columns.

    Null parts match nothing; rows without a party give no edge; one value may
    link many rows on both sides.
    """
    left = _keyed(from_rows, from_key, from_columns, "from", from_parties)
    right = _keyed(to_rows, to_key, to_columns, "to", to_parties).drop("value")
    joined = left.join(right, [f"k{i}" for i in range(len(from_columns))])
    return _edge(joined, relationship_id, at, "value", "value")


def bridge(bridge_rows: DataFrame, source_column: str, target_column: str, from_rows: DataFrame, to_rows: DataFrame, from_key: str, to_key: str, from_column: str, to_column: str, from_parties: DataFrame, to_parties: DataFrame, relationship_id: str, at: Column) -> DataFrame:
    """Edges through a bridge table; a value takes the first record it matches on each side."""

    def first(rows: DataFrame, key: str, column: str, parties: DataFrame, side: str) -> DataFrame:
        one = rows.filter(F.col(column).isNotNull()).groupBy(values.text(F.col(column)).alias(f"{side}_value")).agg(F.min(values.text(F.col(key))).alias("record"))
        return one.join(parties, "record").select(f"{side}_value", F.col("party_id").alias(f"{side}_party"))

    links = bridge_rows.select(values.text(F.col(source_column)).alias("from_value"), values.text(F.col(target_column)).alias("to_value")).filter("from_value is not null and to_value is not null").distinct()
    joined = links.join(first(from_rows, from_key, from_column, from_parties, "from"), "from_value").join(first(to_rows, to_key, to_column, to_parties, "to"), "to_value")
    return _edge(joined, relationship_id, at)


def same_row(parties: DataFrame, table_id: str, from_type: str, to_type: str, rule_id: str, bidirectional: bool, at: Column) -> DataFrame:
    """Edges between two roles of one source row, and back if bidirectional.

    Of several parties of one role the last id counts.
    """
    own = current(parties).filter(F.col("system_table_id") == table_id)

    def role(party_type: str, name: str) -> DataFrame:
        return own.filter(F.col("party_type_id") == party_type).groupBy("source_record_id").agg(F.max("source_party_id").alias(name))

    pairs = role(from_type, "a").join(role(to_type, "b"), "source_record_id")
    ends = [F.struct(F.col("a").alias("x"), F.col("b").alias("y"))] + ([F.struct(F.col("b").alias("x"), F.col("a").alias("y"))] if bidirectional else [])
    both = pairs.select("source_record_id", F.explode(F.array(*ends)).alias("e"))
    return both.select(
        values.relationship_id("SR", F.col("e.x"), F.col("e.y")).alias("party_relationship_id"),
        F.lit(None).cast("string").alias("metadata_relationship_id"),
        F.lit(rule_id).alias("metadata_party_type_relationship_id"),
        F.col("e.x").alias("from_party_id"),
        F.col("e.y").alias("to_party_id"),
        F.col("source_record_id").alias("from_matching_value"),
        F.col("source_record_id").alias("to_matching_value"),
        at.alias("rec_start_date"),
        F.lit(None).cast("timestamp").alias("rec_end_date"),
    )


def all_relationships(sources: Sources, parties: DataFrame, meta: Metadata, at: Column) -> DataFrame:
    """Edges of all relationship rules whose source tables are there.

    In a delta run the from side is the delta and the to side the full table.
    Of edges that several rules find between two parties the first rule's counts.
    """
    found: list[DataFrame] = []
    for order, rule in enumerate(meta.relationship):
        fs, ft, fc = _columns(meta, rule["from_column_id"])
        ts, tt, tc = _columns(meta, rule["to_column_id"])
        from_rows, to_rows = sources.changed(fs, ft), sources.whole(ts, tt)
        if from_rows is None or to_rows is None:
            continue
        f_table, t_table = meta.table(fs, ft), meta.table(ts, tt)
        sides = dict(
            from_key=meta.primary_key(fs, ft),
            to_key=meta.primary_key(ts, tt),
            from_parties=main_parties(parties, f_table["system_table_id"], f_table["main_party_type_id"]),
            to_parties=main_parties(parties, t_table["system_table_id"], t_table["main_party_type_id"]),
            relationship_id=rule["relationship_id"],
            at=at,
        )
        if rule["bridge_table_id"] is not None:
            bs, bt, source = meta.resolve_column(rule["bridge_column_source_id"])
            links = sources.bridge(bs, bt)
            if links is None:
                continue
            edges = bridge(links, source, meta.resolve_column(rule["bridge_column_target_id"])[2], from_rows, to_rows, from_column=fc[0], to_column=tc[0], **sides)
        else:
            edges = foreign_key(from_rows, to_rows, from_columns=fc, to_columns=tc, **sides)
        found.append(edges.withColumn("_order", F.lit(order)))
    for order, rule in enumerate(meta.party_type_relationship, len(meta.relationship)):
        table_id = meta.table(rule["source_system"], rule["source_table"])["system_table_id"]
        edges = same_row(parties, table_id, meta.party_type_id(rule["from_party_type"]), meta.party_type_id(rule["to_party_type"]), rule["party_type_relationship_id"], bool(rule["is_bidirectional"]), at)
        found.append(edges.withColumn("_order", F.lit(order)))
    edges = union(found, f"{schemas.RELATIONSHIP}, _order int")
    first = Window.partitionBy("from_party_id", "to_party_id").orderBy("_order", "from_matching_value")
    return edges.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_order")


def _columns(meta: Metadata, column_id: str) -> tuple[str, str, list[str]]:
    """System, table and columns of a rule's side; composite keys are joined by bars."""
    parts = [meta.resolve_column(c) for c in column_id.split("|")] if "|" in column_id else [meta.resolve_column(column_id)]
    columns = [c for _, _, text in parts for c in text.split("|")]
    return parts[0][0], parts[0][1], columns
