import numpy as np
import pytest
from pyspark.sql import functions as F

from molweave.plans import engine
from molweave.plans.engine import Encoder, FingerprintConfig, fingerprint_strings
from molweave.sources import rsmi, tables
from molweave.streaming.fingerprints import row_local_bits, windowed_counts


@pytest.mark.parametrize(
    ("text", "atoms", "bonds", "h"),
    [("CCO", 3, 2, 6), ("C=C.O", 3, 1, 6), ("c1ccccc1", 6, 6, 6), ("[Na+].[Cl-]", 2, 0, 0), ("C[C@@H](F)O", 4, 3, 5), ("C%12CC%12", 3, 3, 6), ("CC(=O)O", 4, 3, 4), ("c1cc[nH]c1", 5, 5, 5), ("CS(=O)(=O)C", 5, 4, 6), ("", 0, 0, 0), ("O=[Mn]=O", 3, 2, 0), ("[13CH4:7]", 1, 0, 4)],
)
def test_smiles(text, atoms, bonds, h):
    nodes, edges = rsmi.parse_smiles(text)
    assert (len(nodes), len(edges), sum(n["hcount"] for n in nodes)) == (atoms, bonds, h)


@pytest.mark.parametrize("text", ["C1CC", "C(", "C)", "C==C", "[Xx", "C%1", "Q", "C11", "C="])
def test_bad_smiles(text):
    with pytest.raises(ValueError):
        rsmi.parse_smiles(text)


def test_charges_and_orders():
    nodes, edges = rsmi.parse_smiles("[C-]#[N+]CC(=O)[O-]")
    assert [n["charge"] for n in nodes] == [-1, 1, 0, 0, 0, -1] and edges[0]["bond_order"] == 3.0
    assert [n["charge"] for n in rsmi.parse_smiles("[Fe+3].[Ca++].[O--]")[0]] == [3, 2, -2]


def test_errors_stay_in_their_row(spark):
    df = spark.createDataFrame([(1, "CCO>>C=C.O"), (2, "CO>>CO2"), (3, None), (4, "CCO")], "reaction_id long, rsmi string")
    got = {r.reaction_id: r for r in rsmi.read_rsmi(df).collect()}
    assert (len(got[1].reactant.nodes), len(got[1].product.edges)) == (3, 1) and got[1].error is None
    assert got[2].error and got[3].error == "missing" and got[4].error
    f = {r.reaction_id: r for r in fingerprint_strings(df, FingerprintConfig(bits=16)).collect()}
    assert len(f[1].fingerprint) == 16 and f[2].fingerprint is None


def test_encoder(spark):
    enc = Encoder(spark, FingerprintConfig(bits=64))
    m = enc.encode_many(["CCO>>CCO", "CCO.O>>CC(=O)O", "CBr>>CBr"])
    assert m.shape == (3, 64) and not m[0].any() and m[1].any() and (enc.encode_one("CCO.O>>CC(=O)O") == m[1]).all()
    assert enc.encode_many([]).shape == (0, 0)
    with pytest.raises(ValueError, match="0: "):
        enc.encode_many(["CO>>CO2"])
    other = Encoder(spark, FingerprintConfig(bits=64, seed=123)).encode_many(["CCO.O>>CC(=O)O"])
    union = Encoder(spark, FingerprintConfig(bits=64, mode="union")).encode_many(["CCO.O>>CC(=O)O", "CCO>>CCO"])
    assert (other[0] != m[1]).any() and (union[0] != m[1]).any() and union[1].any()
    assert len(engine.fingerprint(spark, "CBr>>CBr", bits=8)) == 8


@pytest.mark.parametrize("bad", [{"bits": 0}, {"bits": -128}, {"m": 0}, {"mode": "invalid"}, {"radius": -1}, {"seed": -1}, {"tokenizer": "x"}, {"sketch": "x"}])
def test_configuration_is_checked(bad):
    with pytest.raises(ValueError):
        FingerprintConfig(**bad)


def test_all_combinations_run(spark):
    df = spark.createDataFrame([(1, "CCO.O>>CC(=O)O")], "reaction_id long, rsmi string")
    for tokenizer, sketch, mode in [("WL", "parity", "delta"), ("morgan", "minhash", "union"), ("path", "CW", "delta"), ("nauty", "srp", "delta")]:
        row = fingerprint_strings(df, FingerprintConfig(tokenizer=tokenizer, sketch=sketch, mode=mode, bits=32, m=16, radius=1)).first()
        assert len(row.fingerprint) == 32 and any(row.fingerprint)


def test_registered_parts(spark):
    engine.register_tokenizer("atoms", lambda n, e, radius, **_: n.select("graph_id", F.col("node_id").alias("token"), F.lit(1).cast("long").alias("cnt")))
    engine.register_sketch("low", lambda d, c: d.select("reaction_id", (F.col("token") % c.bits).cast("int").alias("bit")).distinct())
    df = spark.createDataFrame([(1, "CCO>>CC")], "reaction_id long, rsmi string")
    assert fingerprint_strings(df, FingerprintConfig(tokenizer="atoms", sketch="low", bits=4)).first().fingerprint == [0, 0, 1, 0]


def test_row_local_equals_relational_and_partitioning_does_not_matter(spark):
    texts = ["CCO.O>>CC(=O)O", "CBr.[Na+].[OH-]>>CO.[Na+].[Br-]", "c1ccccc1C=O>>c1ccccc1CO", "CC>>CC"]
    df = spark.createDataFrame(list(enumerate(texts)), "reaction_id long, rsmi string")
    local = {r.reaction_id: r.bits for r in row_local_bits(df, 2, 256).collect()}
    nodes, edges = rsmi.graph_tables(rsmi.read_rsmi(df))
    for parts in (1, 5):
        found = {i: [] for i in range(len(texts))}
        for r in engine.fingerprint_bits(nodes.repartition(parts), edges.repartition(parts), FingerprintConfig(bits=256)).collect():
            found[r.reaction_id].append(r.bit)
        assert {k: sorted(v) for k, v in found.items()} == local


def test_stream_of_fingerprints(spark, tmp_path):
    df = spark.createDataFrame([(1, "CCO>>CC=O"), (2, None)], "reaction_id long, rsmi string")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = row_local_bits(source).writeStream.format("memory").queryName("bits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("bits").where("error is null").count() == 1 and spark.table("bits").count() == 2


def test_windowed_counts_in_batch(spark):
    df = spark.createDataFrame([("2024-01-01 05:00:00", "a"), ("2024-01-01 23:00:00", "a"), ("2024-01-02 01:00:00", "a")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in windowed_counts(df, "t", "k").collect()) == [1, 2]


def test_sinks(spark, tmp_path):
    df = fingerprint_strings(spark.createDataFrame([(1, "CCO>>CC=O")], "reaction_id long, rsmi string"), FingerprintConfig(bits=8)).drop("error")
    ids, matrix = tables.to_matrix(df)
    assert ids.tolist() == [1] and matrix.shape == (1, 8) and isinstance(matrix, np.ndarray)
    tables.write_fingerprints(df, str(tmp_path / "wide"), 8, wide=True)
    assert tables.read_any(spark, str(tmp_path / "wide")).columns == ["reaction_id", *[f"b_{i}" for i in range(8)]]
    assert tables.to_matrix(df.where("false"))[1].shape == (0, 0)


def test_package_surface(spark):
    import molweave

    assert all(hasattr(molweave, n) for n in molweave.__all__)
    texts = ["CCO>>CC=O", "CCO.O>>CC(=O)O"]
    whole = molweave.Encoder.encode(spark, texts, bits=64, radius=1)
    assert whole.shape == (2, 64) and (molweave.Encoder.encode(spark, texts, batch_size=1, bits=64, radius=1) == whole).all()
    for bad in (0, -5):
        with pytest.raises(ValueError):
            molweave.Encoder(spark, batch_size=bad)
    r = molweave.Encoder(spark, molweave.FingerprintConfig(bits=64, radius=1)).result(texts[0])
    assert r.to_binary() == whole[0].tolist() and (r.as_array() == whole[0]).all() and r.mode == "delta"
    assert sum(r.tokens_r.values()) == sum(r.tokens_p.values()) == 6 and len(r.support) == len(r.delta)
    assert r.delta == {t: r.tokens_p.get(t, 0) - r.tokens_r.get(t, 0) for t in r.delta} and "mode delta" in repr(r)
    with pytest.raises(TypeError):
        molweave.Result({}, {}, {}, [], [-1, 1], "delta").to_binary()
    assert "wl" in molweave.describe() and "round" in molweave.describe("wl") and "encode_many" in molweave.Encoder.describe()
    with pytest.raises(ValueError):
        molweave.describe("nothing")
