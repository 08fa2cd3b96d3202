"""Sinks write what the shop's exports contain."""

import glob

from shop_helpers import SF_SMALL


def test_csv_export_header_and_rows(spark, tmp_path):
    from storelake.plans.registry import context
    from storelake.sources.sinks import EXPORT_HEADER, export_sales_csv, read_sales_csv
    t = context(spark, SF_SMALL).t
    path = str(tmp_path / "csv")
    export_sales_csv(t, path)
    parts = sorted(glob.glob(f"{path}/part-*.csv"))
    assert parts
    with open(parts[0]) as fh:
        assert fh.readline().strip() == ",".join(EXPORT_HEADER)
    back = read_sales_csv(spark, path)
    assert back.count() == t.orders.count()
    assert back.where("`Payment Method` IS NOT NULL").count() == 0      # K20


def test_profiles_and_history(spark, tmp_path):
    from storelake.plans.registry import context
    from storelake.sources.sinks import read_user_profiles, write_user_profiles
    t = context(spark, SF_SMALL).t
    path = str(tmp_path / "profiles")
    write_user_profiles(t, path)
    prof = read_user_profiles(spark, path)
    assert prof.count() == t.users.count()
    assert "password" not in prof.columns
    sizes = {r.user_id: r.n for r in prof.selectExpr("user_id", "size(orders) AS n").collect()}
    want = {r.user_id: r["count"] for r in t.orders.where("user_id IS NOT NULL").groupBy("user_id").count().collect()}
    assert {u: n for u, n in sizes.items() if n} == {u: n for u, n in want.items() if u in sizes}
    one = prof.where("size(orders) > 1").first().orders
    assert [o.order_date for o in one] == sorted((o.order_date for o in one), reverse=True)


def test_only_files_that_a_row_names_are_read(spark, tmp_path):
    """A file beyond the reader's size limit lies beside the wanted ones: reading it would fail."""
    from storelake.sources.sinks import read_files
    (tmp_path / "sub").mkdir()
    for k in range(7):
        (tmp_path / "sub" / f"{k}.png").write_bytes(b"image %d" % k)
    (tmp_path / "large.bin").write_bytes(bytes(10_000))
    wanted = spark.createDataFrame([(str(tmp_path / "sub" / f"{k}.png"),) for k in (0, 2, 2, 5)] + [("/no/such.png",), (None,)], "path string")
    old = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        for per_read in (4096, 2):
            got = {r.path: bytes(r.content) for r in read_files(spark, wanted, str(tmp_path), per_read).collect()}
            assert got == {str(tmp_path / "sub" / f"{k}.png"): b"image %d" % k for k in (0, 2, 5)}
        assert read_files(spark, wanted.where("path LIKE '/no%'"), str(tmp_path)).count() == 0
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", old)
    # most bytes are wanted: one scan of the folder
    (tmp_path / "large.bin").unlink()
    every = spark.createDataFrame([(str(tmp_path / "sub" / f"{k}.png"),) for k in range(6)], "path string")
    assert read_files(spark, every, str(tmp_path)).count() == 6


def test_snapshot_key_sum_beyond_a_bigint(spark):
    """The ids of large orders' lines add up beyond 64 bits: an exact SUM fails there, the summary must not."""
    from types import SimpleNamespace

    from shop_helpers import make_tables
    from storelake.plans.registry import load_all
    ids = [(1 << 62) + 1, (1 << 62) + 2, 1 << 62, 5]
    t = make_tables(spark, order_items=[(k, 1, 40, 1, 2.0) for k in ids])
    got = {r.table_name: r for r in load_all()["scan_tables"].fn(t, SimpleNamespace(spark=spark)).collect()}
    assert got["order_items"].n_rows == 4 and got["order_items"].key_sum == (sum(ids) + (1 << 63)) % (1 << 64) - (1 << 63)
    assert got["users"].key_sum == 0


def test_image_files_are_spread_over_folders_and_tasks(spark, tmp_path):
    """One folder per image took 25 ms each; now folders hold many files, each named by its key."""
    from storelake.sources.sinks import write_files
    rows = spark.createDataFrame([(k, f"part {k}") for k in range(1, 400)] + [(7, "part 7"), (8, None)], "image_of long, line string")
    root = tmp_path / "images"
    write_files(rows, str(root), files_per_folder=100)
    found = {f.name: f.read_bytes() for f in root.glob("lot=*/*")}
    want = {f"image_of={k}.txt": b"part %d\n" % k for k in range(1, 400)} | {"image_of=7.txt": b"part 7\npart 7\n"}
    eight = found.pop("image_of=8.txt")
    want.pop("image_of=8.txt")
    assert found == want and sorted(eight.split(b"\n")) == [b"", b"", b"part 8"]
    assert len(list(root.iterdir())) == 5


def _odd_folder(root):
    """Names that Spark's listing holds and names that it leaves out."""
    for folder in ("_h/x", ".k", "_a=1", "_metadata_x", "sp ace%20é", "c._COPYING_", "deep/er"):
        (root / folder).mkdir(parents=True)
    for name in ("a.png", "_x.png", "_x=1.png", ".d.png", "e._COPYING_", "_h/x/i.png", ".k/i.png", "_a=1/i.png", "_metadata", "_metadata_x/i.png",
                 "sp ace%20é/i j%41.png", "c._COPYING_/i.png", "_common_metadata.png", "deep/er/i.png"):
        (root / name).write_bytes(name.encode())
    (root / "empty.png").write_bytes(b"")
    (root / "link.png").symlink_to(root / "a.png")
    (root / "broken.png").symlink_to(root / "none")
    (root / "linked").symlink_to(root / "_h" / "x")


def test_tasks_list_and_read_what_sparks_listing_holds(spark, tmp_path):
    from storelake.sources.sinks import _scan_files, list_files, read_files
    root = tmp_path / "root"
    _odd_folder(root)
    (tmp_path / "outside.png").write_bytes(b"outside")
    want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)).collect()
    assert sorted(r.path for r in list_files(spark, f"file:{root}/").collect()) == sorted(r.path for r in want) and len(want) == 8
    want = {r.path.removeprefix("file:"): bytes(r.content) for r in want}
    every = [f"{top}/{name}" for top, folders, names in root.walk() for name in folders + names]
    other = [f"{root}//a.png", f"{root}/../root/a.png", f"{root}/./a.png", f"{root}/a.png/", f"{root}/a.png/b", f"{root}/{'n' * 300}", str(root),
             f"{root}/nul\0", str(tmp_path / "outside.png"), f"{root}x/a.png", f"{root}/linked/i.png", "a.png", "", None]
    wanted = spark.createDataFrame([(p,) for p in every + other] * 2, "path string")
    for folder, per_read in ((str(root), 4096), (f"file://{root}", 2), (f"{root}/", 1)):
        rows = read_files(spark, wanted, folder, per_read).collect()
        assert {r.path: bytes(r.content) for r in rows} == want and len(rows) == len(want)
    some = spark.createDataFrame([(f"{root}/deep/er/i.png",)], "path string")
    for paths in (wanted, some):                  # the way of other file systems: one scan, named reads
        rows = _scan_files(spark, paths.where("path IS NOT NULL").distinct(), str(root), 1).collect()
        assert {r.path: bytes(r.content) for r in rows} == ({f"{root}/deep/er/i.png": b"deep/er/i.png"} if paths is some else want)


def test_no_file_listing_is_kept_on_the_driver(spark, tmp_path):
    """Spark's scan of a folder keeps each file on the driver and deals some 30 to a task, five times over; tasks now open the wanted ones."""
    from storelake.sources.sinks import list_files, load_images, write_files
    root = str(tmp_path / "images")
    write_files(spark.range(700).selectExpr("id AS image_of", "concat('part ', id) AS line"), root, files_per_folder=50)
    files = list_files(spark, root)
    refs = files.selectExpr("cast(regexp_extract(path, 'image_of=([0-9]+)', 1) AS long) AS item_id", "path AS image_url")
    refs = refs.unionByName(spark.createDataFrame([(-1, None), (-1, None), (-2, ""), (-3, "data:image/png;base64,aGk=")], refs.schema))
    images = load_images(spark, refs, root)
    assert "binaryFile" not in images._jdf.queryExecution().toString()
    assert files.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = sorted((r.item_id, r.image if r.image is None else bytes(r.image)) for r in images.collect() if r.item_id > -2)
    assert got[:2] == [(-1, None), (-1, None)] and got[2:] == [(k, b"part %d\n" % k) for k in range(700)]
    assert sorted((r.item_id, r.image and bytes(r.image)) for r in images.where("item_id < -1").collect()) == [(-3, b"hi"), (-2, None)]


def test_files_written_again_take_the_place_of_the_old_ones(spark, tmp_path):
    from storelake.sources.sinks import write_files
    root = tmp_path / "images"
    for low, text in ((0, "old"), (0, "old"), (50, "new")):
        write_files(spark.range(low, low + 100).selectExpr("id AS image_of", f"'{text}' AS line"), str(root), files_per_folder=30)
    found = {f.name: f.read_bytes() for f in root.glob("lot=*/*")}
    assert found == {f"image_of={k}.txt": b"old\n" if k < 50 else b"new\n" for k in range(150)}
    assert [f.name for f in root.iterdir() if not f.name.startswith("lot=")] == []
