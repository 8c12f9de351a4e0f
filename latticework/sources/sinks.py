"""Writers: statistics and energies as Parquet containers, structures, scores and result documents."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, MutableMapping
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file systems; one that is not there is no error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


class Container(MutableMapping):
    """Named tables of one kind, each with what it was made by, saved as a folder that describes itself.

    kind says what the tables are, such as counts or energies; options has a table's own settings by its key, as those of the term that
    made it. A save writes the tables to a new folder and the manifest last: until then the folder holds what it held, and a
    folder whose first save was broken off has no manifest and cannot be loaded.
    """

    def __init__(self, tables: dict[str, DataFrame] | None = None, kind: str = "tables", options: dict[str, dict] | None = None):
        self._tables, self.kind, self.options = dict(tables or {}), kind, dict(options or {})

    def __getitem__(self, key: str) -> DataFrame:
        return self._tables[key]

    def __setitem__(self, key: str, table: DataFrame) -> None:
        self._tables[key] = table

    def __delitem__(self, key: str) -> None:
        del self._tables[key]
        self.options.pop(key, None)

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def save(self, path: str) -> None:
        if not self._tables:
            raise ValueError("there is nothing to save")
        spark = next(iter(self._tables.values())).sparkSession
        folder, before = f"tables-{uuid.uuid4().hex}", Container._manifest(spark, path)
        for key, table in self._tables.items():
            table.write.parquet(f"{path}/{folder}/{quote(key, safe='')}")
        entries = [{"key": k, "options": self.options.get(k, {}), "columns": t.dtypes} for k, t in self._tables.items()]
        manifest = {"kind": self.kind, "version": 1, "folder": folder, "tables": entries}
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
        if before:
            remove_folder(spark, f"{path}/{before['folder']}")

    @staticmethod
    def _manifest(spark: SparkSession, path: str) -> dict | None:
        try:
            row = spark.read.text(f"{path}/manifest").first()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return json.loads(row["value"]) if row else None

    @classmethod
    def load(cls, spark: SparkSession, path: str, kind: str | None = None) -> Container:
        """The container of a folder; a folder of another kind, an unfinished one or one whose tables have changed is an error."""
        manifest = cls._manifest(spark, path)
        if manifest is None:
            raise ValueError(f"{path} has no manifest: it is no container, or its save was broken off")
        if manifest["version"] != 1 or (kind is not None and manifest["kind"] != kind):
            raise ValueError(f"{path} holds {manifest['kind']} of version {manifest['version']}, not {kind or 'any'} of version 1")
        out = cls(kind=manifest["kind"])
        for t in manifest["tables"]:
            table = spark.read.parquet(f"{path}/{manifest['folder']}/{quote(t['key'], safe='')}")
            if [list(c) for c in table.dtypes] != t["columns"]:
                raise ValueError(f"{path}: the table {t['key']} has not the columns that its manifest names")
            out[t["key"]], out.options[t["key"]] = table, t["options"]
        return out


def score_arrays(positions: DataFrame, scores: DataFrame, by: list[str], position: str, score: str) -> DataFrame:
    """(by, scores): one value for each position, null where there is no score, rounded to three digits."""
    rows = positions.join(scores, [*by, position], "left")
    pair = F.struct(F.col(position).alias("p"), F.round(F.nanvl(F.col(score), F.lit(None).cast("double")), 3).alias("v"))
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["v"]).alias("scores"))


def term_arrays(scores: DataFrame, names: list[str], by: list[str], position: str) -> DataFrame:
    """(by, terms): arrays of every named column in order of position, null where it is missing, rounded to three digits."""
    values = [F.round(F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double")), 3).alias(n) for n in names]
    rows = scores.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("at_"), *values))).alias("r_"))
    return rows.select(*by, F.struct(*[F.col("r_").getField(n).alias(n) for n in names]).alias("terms"))


def result_documents(chains: DataFrame, totals: DataFrame, model: str = "model", terms: DataFrame | None = None, preprocessing: DataFrame | None = None) -> DataFrame:
    """(model, json): local scores by chain and the global scores of every model, as one document.

    chains is (model, chain, scores); with terms(model, chain, terms) the document has all terms of each chain as local_terms, with
    preprocessing(model, preprocessing) what was left out of the model.
    """
    local = chains.groupBy(model).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chain", "scores")))).alias("local_scores"))
    parts = ["local_scores", "global_scores"]
    if terms is not None:
        shown = terms.groupBy(model).agg(F.map_from_entries(F.collect_list(F.struct("chain", "terms"))).alias("local_terms"))
        local, parts = local.join(shown, model, "left"), [*parts, "local_terms"]
    if preprocessing is not None:
        local, parts = local.join(preprocessing.select(model, "preprocessing"), model, "left"), [*parts, "preprocessing"]
    names = [c for c in totals.columns if c != model]
    globals_ = totals.select(model, F.struct(*[F.round(c, 3).alias(c) for c in names]).alias("global_scores"))
    return local.join(globals_, model, "left").select(model, F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("json"))


def scores_as_bfactors(atoms: DataFrame, scores: DataFrame, by: list[str], score: str) -> DataFrame:
    return atoms.drop("bfac").join(scores.select(*by, F.col(score).alias("bfac")), by, "left").withColumn("bfac", F.coalesce("bfac", F.lit(0.0)))


def pdb_line(hetero: Column | None = None) -> Column:
    """The fixed-width record of an atom row."""
    name = F.when(F.length("aname") < 4, F.concat(F.lit(" "), F.rpad("aname", 3, " "))).otherwise(F.col("aname"))
    record = F.lit("ATOM  ") if hetero is None else F.when(hetero, "HETATM").otherwise("ATOM  ")
    return F.format_string("%s%5d %s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", record, "serial", name, F.rpad("altloc", 1, " "), "rname", "chain", "rnum", F.rpad("icode", 1, " "), "x", "y", "z", F.coalesce("occ", F.lit(1.0)), "bfac", "element")


def write_pdb(atoms: DataFrame, path: str) -> None:
    """One folder a model of text records in order of serial."""
    atoms.select("model", "serial", pdb_line(F.col("hetero")).alias("line")).repartition("model").sortWithinPartitions("model", "serial").select("model", "line").write.mode("overwrite").partitionBy("model").text(path)


def write_scores(scores: DataFrame, path: str, columns: list[str], by: str = "model") -> None:
    """Local scores as CSV, one folder a model, in order of chain and number; missing values are left empty."""
    known = [F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if t == "double" else F.col(c) for c, t in scores.select(*columns).dtypes]
    rows = scores.select(by, *known).repartition(by).sortWithinPartitions(by, *[c for c in ("chain", "rnum") if c in columns])
    rows.write.mode("overwrite").partitionBy(by).csv(path, header=True)
