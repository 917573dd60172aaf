"""Control tables on the driver: they shape plans and hold a few hundred rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from kinweave import schemas
from kinweave.sources.tables import read_table

#: More control rows than this are taken for a mistake, not for metadata.
MOST_ROWS = 100_000


def control_rows(df: DataFrame) -> list[dict]:
    rows = [r.asDict() for r in df.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a control table has more than {MOST_ROWS} rows")
    return rows


@dataclass
class Metadata:
    """Control tables as rows, in file order."""

    system: list[dict]
    system_table: list[dict]
    party_type: list[dict]
    column: list[dict]
    relationship: list[dict] = field(default_factory=list)
    party_type_relationship: list[dict] = field(default_factory=list)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Metadata:
        """Read the control tables of a folder; all must be there."""
        read = lambda name: control_rows(read_table(spark, folder, f"metadata_{name}", schemas.METADATA[f"metadata_{name}"]))
        return Metadata(*(read(n) for n in ("system", "system_table", "party_type", "column", "relationship", "party_type_relationship")))

    def table(self, system: str, table: str) -> dict:
        """The system_table row; ValueError if the system or table is unknown."""
        ids = [s["system_id"] for s in self.system if s["system_name"] == system]
        if not ids:
            raise ValueError(f"unknown system {system!r}")
        found = [t for t in self.system_table if t["system_id"] == ids[0] and t["table_name"] == table]
        if not found:
            raise ValueError(f"unknown table {system}.{table}")
        return found[0]

    def party_type_id(self, party_type: str) -> str:
        found = [p["party_type_id"] for p in self.party_type if p["party_type"] == party_type]
        if not found:
            raise ValueError(f"unknown party type {party_type!r}")
        return found[0]

    def party_type_name(self, party_type_id: str) -> str:
        found = [p["party_type"] for p in self.party_type if p["party_type_id"] == party_type_id]
        if not found:
            raise ValueError(f"unknown party type id {party_type_id!r}")
        return found[0]

    def columns(self, system: str, table: str) -> list[dict]:
        return [c for c in self.column if c["source_system"] == system and c["source_table"] == table]

    def resolve_column(self, column_id: str | None) -> tuple[str | None, str | None, str | None]:
        """(system, table, column) of a column id, the first if it repeats; None's for None."""
        if column_id is None:
            return None, None, None
        found = [c for c in self.column if c["column_id"] == column_id]
        if not found:
            raise ValueError(f"unknown column {column_id!r}")
        return found[0]["source_system"], found[0]["source_table"], found[0]["source_column"]

    def primary_key(self, system: str, table: str) -> str:
        """The first relationship column in file order."""
        found = [c["source_column"] for c in self.columns(system, table) if c["is_relationship"]]
        if not found:
            raise ValueError(f"no key column for {system}.{table}")
        return found[0]

    def party_types(self, system: str, table: str) -> list[str]:
        """Distinct party types of a table's attributes, in file order."""
        return list(dict.fromkeys(c["party_type"] for c in self.columns(system, table) if c["is_attribute"] and c["party_type"]))

    def is_conditional(self, system: str, table: str) -> bool:
        return any(c["is_party_type_condition"] for c in self.columns(system, table))

    def is_column_subset(self, system: str, table: str) -> bool:
        return len(self.party_types(system, table)) > 1 and not self.is_conditional(system, table)

    def party_tables(self) -> list[tuple[str, str]]:
        """(system, table) of the tables whose rows are parties, in file order.

        Tables without a party type of their own, such as bridges, are left out.
        """
        names = {s["system_id"]: s["system_name"] for s in self.system}
        all_ = [(names[t["system_id"]], t["table_name"], t["main_party_type_id"]) for t in self.system_table if t["system_id"] in names]
        return [(s, t) for s, t, main in all_ if main is not None or self.is_conditional(s, t) or self.is_column_subset(s, t)]

    def conditions(self, system: str, table: str) -> list[tuple[str, str]]:
        """(condition, party type) of a conditional table, in file order."""
        return [(c["condition_logic"], c["party_type"]) for c in self.columns(system, table) if c["is_party_type_condition"] and c["condition_logic"] and c["party_type"]]

    def attribute_columns(self, system: str, table: str) -> list[dict]:
        return [c for c in self.columns(system, table) if c["is_attribute"] and c["party_type"]]
