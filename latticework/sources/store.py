"""A store of templates: one row a chain, bucketed and sorted by entry and chain, and the ranges of chains that alignments place."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import without_gaps
from ..operators.checks import checked

KEY = ["entry", "chain"]


def _letters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _counted(letters: Column) -> Column:
    """For each letter its number from 1 among the letters that are no gaps; for a gap that of the letter before."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(letters, start, lambda a, c: F.struct((a["n"] + (c != "-").cast("int")).alias("n"), F.array_append(a["out"], a["n"] + (c != "-").cast("int")).alias("out")), lambda a: a["out"])


class TemplateStore:
    """Chains with sequence, their full sequence, and positions, an array of what each of its letters has.

    The table lies in a folder, hashed by entry and chain into buckets and sorted within, with a manifest that is written last: a
    folder without one was not finished and is refused. Alignments are dealt to the same buckets, so that a look-up reads the store where
    it lies and shuffles the alignments alone.
    """

    def __init__(self, spark: SparkSession, path: str, manifest: dict) -> None:
        self.manifest, name = manifest, f"templates_{uuid.uuid4().hex}"
        shape = ", ".join(f"`{n}` {t}" for n, t in manifest["columns"])
        spark.sql(f"CREATE TABLE {name} ({shape}) USING parquet CLUSTERED BY (entry, chain) SORTED BY (entry, chain) INTO {manifest['buckets']} BUCKETS LOCATION '{path}/chains'")
        self.chains = spark.table(name)
        self.chains.schema  # resolved, with its buckets, before the name goes; the files stay
        spark.sql(f"DROP TABLE {name}")

    @classmethod
    def create(cls, templates: DataFrame, path: str, buckets: int) -> TemplateStore:
        """From templates(entry, chain, pos, aa, atomseq_char, ...): aa is the full sequence's letter at pos, atomseq_char - where atoms are missing.

        The positions of a chain must be 1, 2, 3, ...; any other are an error.
        """
        spark, name = templates.sparkSession, f"templates_{uuid.uuid4().hex}"
        if lacking := [c for c in (*KEY, "pos", "aa", "atomseq_char") if c not in templates.columns]:
            raise ValueError(f"templates lack {', '.join(lacking)}")
        own = [c for c in templates.columns if c not in (*KEY, "pos")]
        chains = templates.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pos", *own))).alias("r"))
        whole = F.transform("r", lambda r: r["pos"].cast("int")) == F.sequence(F.lit(1), F.size("r"))
        chains = checked(chains, whole, F.concat_ws(" ", F.lit("the positions of a chain are not 1, 2, 3, ...:"), *KEY))
        chains = chains.select(*KEY, F.array_join(F.transform("r", lambda r: F.coalesce(r["aa"], F.lit("?"))), "").alias("sequence"), F.transform("r", lambda r: F.struct(*[r[c].alias(c) for c in own])).alias("positions"))
        chains.repartition(buckets, *KEY).write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", f"{path}/chains").mode("errorifexists").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")
        manifest = {"kind": "templates", "buckets": buckets, "columns": chains.dtypes}
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")
        return cls(spark, path, manifest)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TemplateStore:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
        if manifest.get("kind") != "templates":
            raise ValueError(f"{path} holds {manifest.get('kind')}, not templates")
        return cls(spark, path, manifest)

    def under(self, alignments: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, entry, chain, rnum, aa, atomseq_char, ...) of the positions that alignments place.

        alignments is (keys, entry, chain, offset, t_offset, t, s): gapped rows of a target t and of the store's chain s, whose first letters
        follow offset letters of the chain and t_offset of the target; rnum counts the target's letters from 1. Positions without
        atoms are left out. A row that is not the stored sequence, or a chain that the store lacks, is an error, whatever is
        selected. Entries beyond the least and the greatest one asked for are not read.
        """
        low, high = (alignments.agg(f("entry")).scalar() for f in (F.min, F.max))
        found = alignments.join(self.chains.where(F.col("entry").between(low, high)), KEY, "left")
        gapless = without_gaps(F.col("s"))
        right = F.coalesce((F.substring("sequence", F.col("offset") + 1, F.length(gapless)) == gapless) & (F.length("t") == F.length("s")) & (F.col("offset") >= 0), F.lit(False))
        rows = checked(found, right, F.concat_ws(" ", F.lit("an alignment does not fit the stored sequence of"), *KEY))
        # aligned letters first, then the positions of these alone
        t, s = _letters(F.col("t")), _letters(F.col("s"))
        both = F.arrays_zip(t.alias("a"), s.alias("b"), _counted(t).alias("i"), _counted(s).alias("j"))
        placed = F.transform(F.filter(both, lambda c: (c["a"] != "-") & (c["b"] != "-")), lambda c: F.struct((F.col("t_offset") + c["i"]).cast("int").alias("rnum"), F.get("positions", F.col("offset") + c["j"] - 1).alias("at")))
        each = rows.select(*dict.fromkeys([*keys, *KEY]), F.explode(placed).alias("p")).select(*dict.fromkeys([*keys, *KEY]), "p.rnum", "p.at.*")
        return each.where("atomseq_char != '-'")
