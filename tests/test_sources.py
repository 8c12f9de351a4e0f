"""Files: mmCIF values, the template store, self-describing containers, regressor files, checks that stay in the plan."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import checks as K
from latticework.operators.models import Network
from latticework.sources import cif
from latticework.sources import readers as R
from latticework.sources.sinks import Container, result_documents
from latticework.sources.store import TemplateStore

CIF = """data_one
# a comment with 'quotes
_entry.id   one
_struct.title
;A title; with a semicolon
and a second line
;
_empty.a .
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.auth_asym_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
ATOM 1 C "C1'" . ALA A 7 X 1.0 -2.5 3 1.00
ATOM 2 N 'N"' B ALA A 8 . 1.5 ? 4 0.50
HETATM 3 O
;O5'
;
. HOH B . Y 0 0 0 1
loop_
_other.name _other.value
'it''s' "#5"
plain 'a b'
"""


def test_star_values():
    assert list(cif.category_rows(CIF, "_struct")) == [("one", {"title": "A title; with a semicolon\nand a second line"})]
    assert list(cif.category_rows(CIF, "_other")) == [("one", {"name": "it''s", "value": "#5"}), ("one", {"name": "plain", "value": "a b"})]
    assert list(cif.category_rows(CIF, "_EMPTY")) == [("one", {"a": None})] and list(cif.category_rows(CIF, "_none")) == []
    assert [b for b, _ in cif.category_rows("data_a _x.y 1 data_b _x.y 2", "_x")] == ["a", "b"]
    for bad, words in (("data_a loop_ _x.a _x.b 1 2 3", "ends within a row"), ("data_a _x.a _x.b 1", "has no value"), ("data_a 5", "without a name"), ("loop_ 1", "no names")):
        with pytest.raises(ValueError, match=words):
            list(cif.category_rows(bad, "_x"))


def test_cif_atoms(spark, tmp_path):
    (tmp_path / "one.cif").write_text(CIF)
    rows = R.read_structures(spark, f"{tmp_path}/*.cif").orderBy("serial").collect()
    assert [(r["model"], r["aname"], r["altloc"], r["chain"], r["rnum"], r["x"], r["y"], r["hetero"]) for r in rows] == [("one", "C1'", "", "X", 7, 1.0, -2.5, False), ("one", 'N"', "B", "A", 8, 1.5, None, False), ("one", "O5'", "", "Y", None, 0.0, 0.0, True)]
    assert cif.read_star(spark, f"{tmp_path}/*.cif", "_entry", ["id", "lacking"]).select("id", "lacking").collect() == [("one", None)]
    (tmp_path / "two.cif").write_text("data_two\n_entry.id two\n")
    with pytest.raises(Exception, match="two.cif has no row of _atom_site"):
        R.read_structures(spark, f"{tmp_path}/*.cif").select("model").collect()


def test_files_without_atoms(spark, tmp_path):
    line = "ATOM      1  CA  ALA A   1       1.000   2.000   3.000  1.00  0.00           C"
    (tmp_path / "a.pdb").write_text(line + "\n")
    assert R.read_structures(spark, f"{tmp_path}/*.pdb").count() == 1
    for name, text in (("b.pdb", "REMARK\n"), ("b.pdb", "")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="no atoms in .*b.pdb"):
            R.read_structures(spark, f"{tmp_path}/*.pdb").select(F.lit(1)).collect()


def test_what_is_left_out(spark):
    shape = "model string, chain string, rnum int, icode string, rname string, aname string, altloc string, element string, occ double"
    atoms = spark.createDataFrame([("m", "A", 1, "", "MSE", "CA", "", "C", 1.0), ("m", "A", 1, "", "MSE", "H", "", "H", 0.0), ("m", "A", 2, "", "ALA", "CA", "B", "C", 1.0), ("m", "A", 3, "", "ALA", "CA", "A", "C", 0.0), ("m", "B", 1, "", "LIG", "C1", "", "C", None)], shape)
    r = R.preprocessing_report(atoms).first()["preprocessing"].asDict()
    assert r == {"atoms": 5, "renamed": 1, "hydrogens": 1, "without_occupancy": 1, "other_residues": 1, "other_locations": 1, "residues_removed": 3, "chains_removed": 1}
    assert R.preprocessed(atoms).count() == 1
    chains = spark.createDataFrame([("m", "A", [0.5])], "model string, chain string, scores array<double>")
    document = json.loads(result_documents(chains, spark.createDataFrame([("m", 0.25)], "model string, s double"), preprocessing=R.preprocessing_report(atoms)).first()["json"])
    assert document["preprocessing"]["other_residues"] == 1 and document["local_scores"] == {"A": [0.5]}


SEQUENCES = {("1abc", "A"): "ACDEFG", ("1abc", "B"): "KLMN", ("2xyz", "A"): "ACAC"}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = [(e, c, k, a, "-" if a == "E" else a, float(k)) for (e, c), s in SEQUENCES.items() for k, a in enumerate(s, 1)]
    path = str(tmp_path_factory.mktemp("store") / "t")
    TemplateStore.create(spark.createDataFrame(rows, "entry string, chain string, pos int, aa string, atomseq_char string, x double"), path, 4)
    return TemplateStore.open(spark, path)


def asked(spark, *rows):
    return spark.createDataFrame(rows, "aln string, entry string, chain string, offset int, t_offset int, t string, s string")


def test_store_gives_ranges(spark, store):
    found = store.under(asked(spark, ("x", "1abc", "A", 1, 10, "WW-WW", "CDEF-"), ("y", "2xyz", "A", 0, 0, "WW", "AC"), ("z", "1abc", "A", 3, 0, "WW", "EF")), ["aln"])
    assert sorted((r["aln"], r["rnum"], r["aa"], r["x"]) for r in found.collect()) == [("x", 11, "C", 2.0), ("x", 12, "D", 3.0), ("x", 13, "F", 5.0), ("y", 1, "A", 1.0), ("y", 2, "C", 2.0), ("z", 2, "F", 5.0)]


def test_store_is_not_shuffled(spark, store):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.under(asked(spark, ("x", "1abc", "A", 1, 10, "WW", "CD")), ["aln"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.split("Subquery")[0].count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_store_refuses(spark, store, tmp_path):
    for row in (("x", "1abc", "A", 0, 0, "WW", "AX"), ("x", "1abc", "A", 5, 0, "WW", "GA"), ("x", "9non", "A", 0, 0, "W", "A"), ("x", "1abc", "A", 0, 0, "W", "AC"), ("x", "1abc", "A", -1, 0, "W", "A")):
        with pytest.raises(Exception, match=f"does not fit the stored sequence of {row[1]} A"):
            store.under(asked(spark, row), ["aln"]).select("rnum").collect()
    gap = spark.createDataFrame([("a", "A", 1, "A", "A"), ("a", "A", 3, "C", "C")], "entry string, chain string, pos int, aa string, atomseq_char string")
    with pytest.raises(Exception, match="not 1, 2, 3, ...: a A"):
        TemplateStore.create(gap, f"{tmp_path}/e", 2)
    Container({"a": spark.range(2)}, "counts").save(f"{tmp_path}/c")
    with pytest.raises(ValueError, match="holds counts, not templates"):
        TemplateStore.open(spark, f"{tmp_path}/c")
    with pytest.raises(ValueError, match="lack aa, atomseq_char"):
        TemplateStore.create(spark.createDataFrame([("a", "A", 1)], "entry string, chain string, pos int"), f"{tmp_path}/d", 2)


def test_containers_describe_themselves(spark, tmp_path):
    path = f"{tmp_path}/c"
    with pytest.raises(ValueError, match="no manifest"):
        Container.load(spark, path)
    options = {"a/b": {"term": "packing", "cutoff": 5.0, "most": 32}}
    Container({"a/b": spark.range(3), "c": spark.range(4)}, "counts", options).save(path)
    again = Container.load(spark, path, "counts")
    assert again.options["a/b"] == options["a/b"] and again.options["c"] == {} and again["a/b"].count() == 3
    with pytest.raises(ValueError, match="holds counts .* not energies"):
        Container.load(spark, path, "energies")
    del again["c"]
    again["a/b"] = again["a/b"].withColumn("w", F.lit(1.0))
    again.save(path)  # replaces what it was read from
    assert Container.load(spark, path)["a/b"].columns == ["id", "w"] and list(Container.load(spark, path)) == ["a/b"]
    assert len([p for p in (tmp_path / "c").iterdir() if p.name.startswith("tables-")]) == 1
    folder = next(p for p in (tmp_path / "c").iterdir() if p.name.startswith("tables-"))
    spark.range(3).write.mode("overwrite").parquet(f"{folder}/a%2Fb")
    with pytest.raises(ValueError, match="has not the columns"):
        Container.load(spark, path)


def test_regressor_files():
    mean, std, w1, b1, w2, b2 = [1.0, 2.0], [2.0, 4.0], [[1.0, -1.0], [0.5, 2.0], [0.0, 1.0]], [0.0, 1.0, -1.0], [[1.0, 0.5, 2.0]], [0.25]
    flat = [*mean, *std, *b1, *b2, *np.array(w1).ravel(), *np.array(w2).ravel()]
    data = struct.pack("<9i", 444222, 1, 3, 2, 3, 1, 0, 1, 0) + np.array(flat, "<f4").tobytes()
    net = Network.from_bytes(data)
    assert net.to_bytes() == data
    x = (np.array([3.0, 10.0]) - mean) / std
    want = (np.maximum(np.array(w1) @ x + b1, 0) @ np.array(w2).T + b2)[0]
    assert net.predict_batch(np.array([[3.0, 10.0]]))[0] == pytest.approx(want)
    for bad, words in ((b"", "known version"), (data[:-4], "length does not fit"), (struct.pack("<3i", 444222, 1, 1), "input layer and another"), (data[:24] + struct.pack("<i", 7) + data[28:], "unknown activations")):
        with pytest.raises(ValueError, match=words):
            Network.from_bytes(bad)


def test_checks_stay_in_the_plan(spark):
    rows = spark.createDataFrame([("m", "A", 1, ""), ("m", "A", 2, "")], "model string, chain string, rnum int, icode string")
    assert K.unique_numbers(rows, ["model", "chain"], icode="icode").columns == rows.columns
    for bad in (("m", "A", 2, ""), ("m", "A", 3, "B")):
        with pytest.raises(Exception, match="unique and without insertion codes: m A [23]"):
            K.unique_numbers(rows.union(spark.createDataFrame([bad], rows.schema)), ["model", "chain"], icode="icode").select("model").collect()
    files = spark.createDataFrame([("ab.1",), ("cd.2",)], "name string")
    prefixes = spark.createDataFrame([("ab",), ("cd",)], "p string")
    assert sorted(K.one_prefix(files, "name", prefixes, "p").collect()) == [("ab.1", "ab"), ("cd.2", "cd")]
    for more in (("a",), ("x",)):
        wrong = files.union(spark.createDataFrame([("zz",)], "name string")) if more == ("x",) else files
        with pytest.raises(Exception, match="not exactly one prefix fits"):
            K.one_prefix(wrong, "name", prefixes.union(spark.createDataFrame([more], "p string")), "p").select("name").collect()
    assert K.at_most(rows, ["rnum"], 2, "numbers").count() == 2
    with pytest.raises(Exception, match="more than 1 numbers: 2"):
        K.at_most(rows, ["rnum"], 1, "numbers").select("model").collect()
    cells = spark.createDataFrame([("C", 0), ("D", 3)], "a string, d int")
    assert K.cells_within(cells, {"d": 4}, {"a": ["C", "D"]}).count() == 2
    for bad in (("C", 4), ("C", -1), ("C", None), ("X", 1), (None, 1)):
        with pytest.raises(Exception, match="no such cell of a, d"):
            K.cells_within(cells.union(spark.createDataFrame([bad], cells.schema)), {"d": 4}, {"a": ["C", "D"]}).select("a").collect()
    with pytest.raises(Exception, match="differ in length"):
        R.sequence_features(spark.createDataFrame([("ABC", "HH")], "s string, t string"), ["s", "t"]).select(F.lit(1)).collect()
