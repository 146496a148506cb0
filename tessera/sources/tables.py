"""Reading tables, declared field types, and results."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@dataclass(frozen=True)
class Type:
    """int, varchar(n) of at most n UTF-8 bytes, or boolean."""

    kind: str
    length: int = 0

    def __post_init__(self):
        if self.kind not in ("int", "varchar", "boolean"):
            raise ValueError(f"expected int, varchar or boolean, not {self.kind}")

    @property
    def spark(self) -> T.DataType:
        return {"int": T.IntegerType(), "varchar": T.StringType(), "boolean": T.BooleanType()}[self.kind]

    @property
    def default(self) -> int | str | bool:
        """What a field that an insert leaves out becomes."""
        return {"int": 0, "varchar": "", "boolean": False}[self.kind]

    @property
    def code(self) -> int:
        return {"int": 4, "varchar": 12, "boolean": -7}[self.kind]  # fixed values of the catalog

    @property
    def size(self) -> int:
        """Bytes of a field in a record."""
        return 4 + self.length if self.kind == "varchar" else 4

    def check(self, name: str, value: object) -> None:
        wanted = {"int": int, "varchar": str, "boolean": bool}[self.kind]
        if type(value) is not wanted:
            raise ValueError(f"{name} takes {self.kind}, not {value!r}")
        if self.kind == "int" and not -(2**31) <= value < 2**31:
            raise ValueError(f"{name} is out of range: {value}")
        if self.kind == "varchar" and len(value.encode()) > self.length:
            raise ValueError(f"{name} takes at most {self.length} bytes")


def typed(fields: dict[str, Type]) -> T.StructType:
    """A schema that keeps varchar lengths in its metadata."""
    return T.StructType([T.StructField(n, t.spark, False, {"length": t.length} if t.kind == "varchar" else {}) for n, t in fields.items()])


def result_rows(df: DataFrame) -> Iterator[Row]:
    """The rows one after the other; a partition at most is held by the driver."""
    return df.toLocalIterator()


def display_sizes(df: DataFrame) -> dict[str, int]:
    """Width of each column in print: the longer of its name and its values' greatest length, and one."""
    return {f.name: 1 + max(len(f.name), f.metadata.get("length", 6) if isinstance(f.dataType, T.StringType) else 6) for f in df.schema}
