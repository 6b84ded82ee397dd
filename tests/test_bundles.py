import numpy as np
import pytest

from sigweave.sources import bundles, io


def expected(name, x, y, groups):
    x = x[:, None, :] if x.ndim == 2 else x
    return sorted((name, e, int(groups[e]), int(y[e]), f"c{c}", tuple(map(float, x[e, c]))) for e in range(len(x)) for c in range(x.shape[1]))


@pytest.mark.parametrize("slice_bytes", [1, 700, 1 << 20])
def test_bundles_are_read_in_slices(spark, tmp_path, slice_bytes):
    """Stored and compressed, with and without groups, two and three dimensions, empty: the same rows for any slice."""
    rng = np.random.default_rng(8)
    x3, x2, y = rng.standard_normal((23, 2, 16)).astype("float32"), rng.standard_normal((9, 16)), np.arange(23) % 3
    np.savez(tmp_path / "b.npz", X=x3, y=y, groups=np.arange(23) // 5)
    np.savez(tmp_path / "a.npz", X=x2, y=y[:9])
    np.savez_compressed(tmp_path / "c.npz", X=x3, y=y)
    np.savez(tmp_path / "d.npz", X=x3[:0], y=y[:0])
    spark.dataSource.register(bundles.EpochBundles)
    df = spark.read.format("epoch_bundles").option("slice", slice_bytes).load(str(tmp_path))
    got = sorted((*r[:5], tuple(r["x"])) for r in df.collect())
    a, b, c = (str(tmp_path / f"{k}.npz") for k in "abc")
    assert got == expected(a, x2, y, [0] * 9) + expected(b, x3, y, np.arange(23) // 5) + expected(c, x3, y, [2] * 23)
    parts = bundles.BundleReader(str(tmp_path), slice_bytes).partitions()
    assert len(parts) == {1: 9 + 23 + 1, 700: 2 + 5 + 1, 1 << 20: 3}[slice_bytes]
    assert io.read_bundles(spark, a).count() == 9


def test_a_large_bundle_takes_many_small_slices(tmp_path, monkeypatch):
    """A slice's task reads its own bytes alone."""
    n = 4000
    np.savez(tmp_path / "big.npz", X=np.zeros((n, 4, 256)), y=np.zeros(n, int))
    reader = bundles.BundleReader(f"file://{tmp_path}", 1 << 20)
    parts = reader.partitions()
    assert len(parts) == -(-n // 128) and parts[-1].stop == n
    asked = []
    plain = bundles.Member.rows
    monkeypatch.setattr(bundles.Member, "rows", lambda self, a, b: asked.append((b - a) * self.row) or plain(self, a, b))
    assert sum(b.num_rows for b in reader.read(parts[7])) == 128 * 4 and max(asked) <= 1 << 20


def test_objects_are_refused(tmp_path):
    np.savez(tmp_path / "o.npz", X=np.array([[{}]], object), y=np.zeros(1))
    with pytest.raises(ValueError):
        bundles.BundleReader(str(tmp_path), 100).partitions()


def test_a_recording_is_written_by_one_task(spark, tmp_path):
    """Rows of a recording lie in many partitions, and yet in one file."""
    from sigweave.sources import io

    rows = spark.range(0, 600, 1, 12).selectExpr("id % 5 AS recording_id", "CAST(id AS double) AS quantity")
    io.write_by_recording(rows, f"{tmp_path}/signal")
    assert {p.parent.name for p in tmp_path.glob("signal/*/*.parquet")} == {f"recording_id={r}" for r in range(5)}
    assert len(list(tmp_path.glob("signal/*/*.parquet"))) == 5
    back = spark.read.schema("quantity double, recording_id long").parquet(f"{tmp_path}/signal")
    assert sorted((r["recording_id"], r["quantity"]) for r in back.collect()) == sorted((r["recording_id"], r["quantity"]) for r in rows.collect())
