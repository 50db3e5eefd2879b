"""Silver and gold tables as Parquet folders, and one pointer to the current ones.

A table is one or more folders. A commit writes new ones and then swaps the pointer:
readers see all of its tables or none. An append adds a folder and leaves the others as they
are. One writer at a time is assumed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..schemas import SILVER
from .files import names, read_json, remove, swap_json
from .staging import drop_staged, staged

#: Folders of a table, from which on the next append writes them anew as one.
MOST_FOLDERS = 64


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> dict[str, list[str]]:
        return read_json(f"{self.root}/CURRENT", {})

    def table(self, name: str) -> DataFrame:
        """The current version; an empty table of the right columns if there is none."""
        folders = self.current().get(name)
        if folders is None:
            return self.spark.createDataFrame([], SILVER[name][0])
        return self.read(name, folders)

    def read(self, name: str, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(SILVER[name][0]) if name in SILVER else self.spark.read
        return reader.parquet(*(f"{self.root}/{name}/{folder}" for folder in folders))

    def write(self, name: str, df: DataFrame) -> list[str]:
        """Writes a folder that no pointer names yet."""
        folder = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{folder}")
        return [folder]

    def added(self, name: str, df: DataFrame) -> list[str]:
        """Folders of the table with rows added, which no pointer names yet; only the rows are written, but for one time in `MOST_FOLDERS`."""
        folders = self.current().get(name, [])
        if len(folders) >= MOST_FOLDERS:
            return self.write(name, self.table(name).unionByName(df))
        return folders + self.write(name, df)

    def point(self, tables: dict[str, list[str]]) -> None:
        swap_json(f"{self.root}/CURRENT", self.current() | tables)

    def commit(self, **tables: DataFrame) -> None:
        self.point({name: self.write(name, df) for name, df in tables.items()})

    def append(self, **rows: DataFrame) -> None:
        """Commits tables with rows added."""
        self.point({name: self.added(name, df) for name, df in rows.items()})

    def insert(self, name: str, df: DataFrame) -> int:
        """Adds the rows of df one commit at a time, as clients that write single rows do, and gives their number.

        A baseline to time `append` against: it takes a job for every row, which come to the driver one partition at a time.
        """
        n = 0
        for row in df.toLocalIterator():
            self.append(**{name: self.spark.createDataFrame([row], df.schema)})
            n += 1
        return n

    def drop(self, *tables: str) -> None:
        """Takes tables out of the pointer, then deletes their folders; no one may be reading them."""
        swap_json(f"{self.root}/CURRENT", {name: folders for name, folders in self.current().items() if name not in tables})
        for name in tables:
            remove(f"{self.root}/{name}")

    def vacuum(self) -> list[str]:
        """Deletes the folders that the pointer does not name (old ones, and those of failed commits), and gives their names; no one may be reading or writing."""
        current, gone = self.current(), []
        for name in current:
            for folder in names(f"{self.root}/{name}", folders=True):
                if folder not in current[name]:
                    remove(f"{self.root}/{name}/{folder}")
                    gone.append(f"{name}/{folder}")
        return gone

    def ensure_tables(self) -> list[str]:
        """Makes the silver tables that are not there yet, empty, and gives their names.

        Tables that are there stay as they are. Columns that a schema has gained since are
        null in their old folders, so there is nothing else to migrate.
        """
        missing = [name for name in SILVER if name not in self.current()]
        self.commit(**{name: self.spark.createDataFrame([], SILVER[name][0]) for name in missing})
        return missing

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """df, written once beside the tables and read back."""
        return staged(df, name, self.root)

    def drop_stages(self) -> None:
        drop_staged(self.spark, self.root)

    def refresh(self, gold: dict[str, DataFrame]) -> None:
        """Replaces gold tables by snapshots of the given plans."""
        self.commit(**gold)
