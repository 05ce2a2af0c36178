"""H5AD files. h5py is not here, so a stand-in of the same interface reads pickled files: it shows that tables, blocks, layouts and refusals are
right, not that HDF5 is."""

import pickle
from argparse import Namespace

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortlens import __main__ as cli
from cohortlens.config import Config
from cohortlens.operators import cells as C
from cohortlens.operators import distribution as D
from cohortlens.sources import h5ad
from cohortlens.sources.h5ad import read_h5ad

STANDIN = '''
import pickle

class Dataset:
    def __init__(self, value, attrs, chunks):
        self.value, self.attrs, self.chunks, self.shape, self.dtype = value, attrs, chunks, value.shape, value.dtype
    def __getitem__(self, at):
        return self.value[at]
    def __len__(self):
        return len(self.value)

class Group:
    def __init__(self, items, attrs):
        self.items_, self.attrs = items, attrs
    def __getitem__(self, name):
        return build(self.items_[name])
    def __contains__(self, name):
        return name in self.items_
    def keys(self):
        return self.items_.keys()
    def __enter__(self):
        return self
    def __exit__(self, *_):
        return False

def build(node):
    if not isinstance(node, dict):
        return Dataset(node, {}, None)
    if "value" in node:
        return Dataset(node["value"], node.get("attrs", {}), node.get("chunks"))
    return Group(node["items"], node.get("attrs", {}))

def File(path, mode="r"):
    if hasattr(path, "read"):
        return build(pickle.loads(path.read()))
    with open(path, "rb") as f:
        return build(pickle.load(f))
'''


@pytest.fixture(scope="module")
def h5py(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("standin") / "h5py.py"
    path.write_text(STANDIN)
    spark.sparkContext.addPyFile(str(path))


def group(attrs=None, **items):
    return {"items": items, "attrs": attrs or {}}


def words(*xs):
    return np.array([x.encode() for x in xs], object)


def matrix(dense, layout, repeat=False):
    if layout == "dense":
        return {"value": dense, "chunks": (2, dense.shape[1])}
    lie = dense if layout == "csr" else dense.T
    rows, cols = np.nonzero(lie)
    values = lie[rows, cols]
    if repeat:  # an entry in two parts, and a stored zero
        rows, cols, values = np.r_[rows[0], rows, rows[-1]], np.r_[cols[0], cols, cols[-1]], np.r_[1.0, values - np.r_[1.0, np.zeros(len(values) - 1)], 0.0]
    ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(lie)))]
    return group({"encoding-type": f"{layout}_matrix", "shape": np.array(dense.shape)}, indptr=ends, indices=cols.astype(np.int32), data=values.astype(np.float32))


def study(donors=6, each=12, genes=7, seed=3):
    rng = np.random.default_rng(seed)
    n = donors * 2 * each
    sample = np.repeat([f"d{d}_s{c}" for d in range(donors) for c in (0, 1)], each)
    dense = rng.negative_binomial(2, 0.4, (n, genes)).astype(float)
    dense[5] = 0
    return sample, dense, rng.choice(["A", "B"], n)


def file_of(sample, dense, state, layout, **more):
    n, genes = dense.shape
    codes, levels = (np.unique(state, return_inverse=True)[k] for k in (1, 0))
    obs = group(
        {"_index": "names", "column-order": words("sample", "kind", "phenotype", "donor", "depth", "flag", "age")},
        names=words(*[f"cell{i}" for i in range(n)]), sample=words(*sample), phenotype=words(*[s[-1] for s in sample]), donor=words(*[s.split("_")[0] for s in sample]),
        kind=group({"encoding-type": "categorical"}, categories=words(*levels), codes=codes.astype(np.int8)), depth=np.where(np.arange(n) % 5 == 0, np.nan, np.arange(n) / 2),
        flag=np.arange(n) % 2 == 0, age=group({"encoding-type": "nullable-integer"}, values=np.arange(n), mask=np.arange(n) % 3 == 0),
    )
    var = group({"_index": "_index"}, _index=words(*[f"g{j}" for j in range(genes)]))
    return group(None, **({"obs": obs, "var": var, "X": matrix(dense, layout, more.get("repeat")), "layers": group(None, raw=matrix(dense * 2, layout))} | more.get("parts", {})))


def write(path, content):
    path.write_bytes(pickle.dumps(content))
    return str(path)


@pytest.mark.parametrize("layout", ["dense", "csr", "csc"])
def test_layouts_give_the_same_tables(spark, h5py, tmp_path, layout):
    sample, dense, state = study()
    path = write(tmp_path / "x.h5ad", file_of(sample, dense, state, layout, repeat=layout != "dense"))
    cells, counts = read_h5ad(spark, path, chunk_size=7)
    rows, cols = np.nonzero(dense)
    assert sorted(map(tuple, counts.collect())) == sorted((f"cell{i}", f"g{j}", int(dense[i, j])) for i, j in zip(rows, cols))
    assert dict(counts.dtypes)["count"] == "bigint"
    doubled = read_h5ad(spark, path, "raw", 1000)[1]
    assert doubled.agg(F.sum("count")).first()[0] == 2 * int(dense.sum())
    got = {r["cell_id"]: r for r in cells.collect()}
    assert len(got) == len(dense) and cells.columns == ["cell_id", "sample", "kind", "phenotype", "donor", "depth", "flag", "age"]
    assert [t for _, t in cells.dtypes] == ["string", "string", "string", "string", "string", "double", "boolean", "bigint"]
    assert all(got[f"cell{i}"]["kind"] == state[i] and got[f"cell{i}"]["sample"] == sample[i] for i in range(len(dense)))
    assert [got[f"cell{i}"]["depth"] for i in range(6)] == [None, 0.5, 1.0, 1.5, 2.0, None] and [got[f"cell{i}"]["age"] for i in range(4)] == [None, 1, 2, None]


def test_blocks_cover_the_matrix_once():
    dense = np.arange(35.0).reshape(7, 5)
    for layout in ("dense", "csr", "csc"):
        space = {}
        exec(STANDIN, space)  # noqa: S102
        m = h5ad.Matrix(space["build"](group(None, X=matrix(dense, layout))), "X", dense.shape)
        blocks = m.blocks(3)
        assert blocks[0][0] == 0 and all(a[1] == b[0] for a, b in zip(blocks, blocks[1:])) and len(blocks) > 1
        if layout == "dense":
            assert all(b % 2 == 0 or b == 7 for _, b in blocks)  # chunks of two rows
        back = np.zeros_like(dense)
        for a, b in blocks:
            for rows, cols, values in m.entries(a, b):
                assert (back[rows, cols] == 0).all()
                back[rows, cols] = values
        assert (back == dense).all()


def test_old_categories(spark, h5py, tmp_path):
    obs = group({"_index": "index"}, index=words("a", "b", "c"), kind=np.array([1, -1, 0]), __categories=group(None, kind=words("x", "y")))
    content = group(None, obs=obs, var=group({"_index": "index"}, index=words("g")), X=matrix(np.array([[1.0], [2.0], [3.0]]), "csr"))
    cells, _ = read_h5ad(spark, write(tmp_path / "old.h5ad", content))
    assert sorted(map(tuple, cells.collect())) == [("a", "y"), ("b", None), ("c", "x")]


def test_files_that_do_not_fit_are_refused(spark, h5py, tmp_path):
    sample, dense, state = study(3, 4)

    def refused(text, kind=PySparkException, layer=None, **parts):
        path = write(tmp_path / f"bad{len(list(tmp_path.iterdir()))}.h5ad", file_of(sample, dense, state, "csr", parts=parts))
        with pytest.raises((kind, ValueError), match=text):
            read_h5ad(spark, path, layer)[1].collect()

    refused("names are", X=matrix(dense[:-1], "dense"))
    refused("do not fit each other", X=matrix(dense[:-1], "csr"))
    broken = matrix(dense, "csc")
    broken["items"]["indices"] = broken["items"]["indices"][:-1]
    refused("do not fit each other", X=broken)
    beyond = matrix(dense, "csr")
    beyond["items"]["indices"] = beyond["items"]["indices"] + 1
    refused("beyond its names", X=beyond)
    refused("unknown layout", X=group({"encoding-type": "coo"}, indptr=np.zeros(2)))
    refused("no layer", layer="spliced")
    refused("non-negative whole", X=matrix(dense + 0.5, "dense"))
    refused("non-negative whole", X=matrix(-dense, "csr"))
    refused("non-negative whole", X=matrix(np.where(dense > 3, np.nan, dense), "dense"))
    refused("repeats names of genes", var=group({"_index": "i"}, i=words(*["g"] * dense.shape[1])))
    refused("compound", obs=np.zeros(3))


def test_any_path_that_spark_reaches(spark, h5py, tmp_path):
    sample, dense, state = study(3, 4)
    write(tmp_path / "far.h5ad", file_of(sample, dense, state, "csc"))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.h5.link./in", f"file://{tmp_path}")
    cells, counts = read_h5ad(spark, "viewfs://h5/in/far.h5ad")
    assert cells.count() == len(dense) and counts.agg(F.sum("count")).first()[0] == int(dense.sum())
    assert read_h5ad(spark, f"file://{tmp_path}/far.h5ad")[0].count() == len(dense)


@pytest.mark.parametrize("layout", ["csr", "csc"])
def test_runs_on_a_file_equal_runs_on_tables(spark, h5py, tmp_path, layout):
    sample, dense, state = study()
    path = write(tmp_path / "x.h5ad", file_of(sample, dense, state, layout))
    rows, cols = np.nonzero(dense)
    table = spark.createDataFrame([(f"cell{i}", sample[i], str(state[i]), sample[i][-1], sample[i].split("_")[0]) for i in range(len(dense))], "cell_id string, sample string, kind string, phenotype string, donor string")
    table.write.parquet(f"{tmp_path}/cells")
    spark.createDataFrame([(f"cell{i}", f"g{j}", int(dense[i, j])) for i, j in zip(rows, cols)], "cell_id string, gene_id string, count long").write.parquet(f"{tmp_path}/counts")
    base = dict(sample_id="sample", cell_type="kind", group="donor", min_cells=2, chunk_size=5)
    config = Config(**base)
    pairs = [cli.read_cells(spark, Namespace(h5ad=h, cells=c, counts=k), config) for h, c, k in ((path, None, None), (None, f"{tmp_path}/cells", f"{tmp_path}/counts"))]
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert same(pairs[0][0], pairs[1][0]) and same(pairs[0][1], pairs[1][1])
    assert same(*(C.pseudobulk(cells, counts, 2) for cells, counts in pairs))
    features = Config(**base, single_cell_mode="distribution", input_scale="features", normalization="none", imputation="median", feature_blocks=("abundance", "gene_mean", "gene_tail", "program_q90"), programs={"p": ("g0", "g1")})
    assert same(*(D.distribution_features(cells, counts, features).withColumn("value", F.round("value", 9)) for cells, counts in pairs))
    with pytest.raises(ValueError, match="lack the columns batch"):
        cli.read_cells(spark, Namespace(h5ad=path, cells=None, counts=None), Config(**base, batch="batch"))
    with pytest.raises(ValueError, match="blanks in age"):
        cli.read_cells(spark, Namespace(h5ad=path, cells=None, counts=None), Config(**base, covariates=("age",)))
    with pytest.raises(ValueError, match="either"):
        cli.read_cells(spark, Namespace(h5ad=path, cells=f"{tmp_path}/cells", counts=None), config)


def test_command_line_reads_a_file(spark, h5py, tmp_path, capsys):
    sample, dense, state = study(10, 10, 6)
    dense[:, 0] += 6 * np.array([int(s[-1]) for s in sample])
    path = write(tmp_path / "x.h5ad", file_of(sample, dense, state, "csc"))
    args = ["single-cell", "--h5ad", path, "--sample-id", "sample", "--cell-type", "kind", "--cell-type-value", "A", "--group", "donor", "--min-cells", 1, "--outer-folds", 2, "--inner-folds", 2, "--permutations", 0, "--stability-resamples", 2, "--min-count", 1, "--output", tmp_path / "run"]
    assert cli.main([str(a) for a in args]) == 0, capsys.readouterr().err
    assert spark.read.parquet(f"{tmp_path}/run/evidence.parquet").where("feature_id = 'g0'").count() == 1
    assert cli.main(["single-cell", "--output", str(tmp_path / "no")]) == 1 and "either" in capsys.readouterr().err
