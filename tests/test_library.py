from pyspark.sql import functions as F

from tests.test_pairs import TRACKS, folder, tags
import pytest

from tonearm.operators import catalog as c
from tonearm.operators import dedupe as d
from tonearm.operators import quality as q
from tonearm.operators import rules as r
from tonearm.sources import tables
from tonearm.streaming import incoming


def rows(df, *names):
    return sorted(tuple(x[n] for n in names) for x in df.collect())


def tracks(spark, *folders):
    return spark.createDataFrame([x for f in folders for x in f], TRACKS)


def test_scan_reads_files_and_hashes(spark, tmp_path):
    (tmp_path / "al.bum").mkdir()
    (tmp_path / "al.bum" / "A.MP3").write_bytes(b"y")
    (tmp_path / "al.bum" / "b.txt").write_bytes(b"x")
    got = tables.scan_files(spark, str(tmp_path), kinds=("md5",))
    assert rows(got, "file", "ext", "size", "file_hash", "folder_name") == [("A.MP3", ".mp3", 1, "415290769594460e2e485922904f345d", "al.bum"), ("b.txt", ".txt", 1, "9dd4e461268c8034f5c8564e155c67a6", "al.bum")]
    assert rows(c.audio_files(got), "file") == [("A.MP3",)]


def test_files_of_zero_bytes_and_lost_files_come_from_a_manifest(spark, tmp_path):
    (tmp_path / "al").mkdir()
    (tmp_path / "al" / "a.mp3").write_bytes(b"y")
    (tmp_path / "al" / "e.mp3").write_bytes(b"")
    paths = [(f"{tmp_path}/al/{n}", size) for n, size in (("a.mp3", 1), ("e.mp3", 0), ("lost.mp3", 7))] + [("/elsewhere/x.mp3", 0)]
    manifest = spark.createDataFrame(paths, "path string, size long").withColumn("modified", F.lit(None).cast("timestamp"))
    got = tables.scan_files(spark, str(tmp_path), kinds=("md5", "sha256"), manifest=manifest)
    assert rows(got.withColumn("sha", F.left("sha256", F.lit(8))), "file", "size", "file_hash", "sha", "folder_name") == [
        ("a.mp3", 1, "415290769594460e2e485922904f345d", "a1fce436", "al"), ("e.mp3", 0, "d41d8cd98f00b204e9800998ecf8427e", "e3b0c442", "al"), ("lost.mp3", 7, None, None, "al"),
    ]


def test_csv_fields_equal_the_standard_reader(spark):
    import csv

    lines = ["a,b", '"Smith, John",Smitty', '"say ""x""",y', ",", "a,", ",b", "x", "a,b,c", 'in"side,"tail"more', '"",""', " a , b ", '5" disc,z', '"open,1', "\ttab\t,\u00a0nb\u00a0"]
    own = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string").select("line_no", tables.csv_fields(F.col("line")).alias("fields"))
    got = {r.line_no: r.fields for r in own.collect()}  # each line for itself; tests/test_lists.py reads files
    want = [next(csv.reader([x])) for x in lines]
    assert [got[k] for k in sorted(got)] == want


def test_alias_file_with_quotes_and_white_space(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"Smith, John",Smitty\n\tTab\u2003,\x1f v \n', encoding="utf-8")
    assert rows(tables.read_artist_alias(spark, str(tmp_path / "a.csv")), "key", "value") == [("smith, john", "Smitty"), ("tab", "v")]
    assert rows(tables.read_artist_alias(spark, str(tmp_path / "a.csv"), keep_case=True), "key") == [("Smith, John",), ("Tab",)]


def test_the_last_line_wins_whatever_the_size_of_its_file(spark, tmp_path):
    for n, (small, large) in enumerate((("a", "b"), ("b", "a"))):
        folder_ = tmp_path / str(n)
        folder_.mkdir()
        (folder_ / f"{small}.csv").write_text("k,small\n")
        (folder_ / f"{large}.csv").write_text("k,early\n" + "".join(f"x{i},y\n" for i in range(5000)) + "k,large\n")
        got = {r.key: r.value for r in tables.read_artist_alias(spark, str(folder_)).where("key = 'k'").collect()}
        assert got == {"k": "large" if large == "b" else "small"}
    with_parts = {r.key: r.value for r in tables.read_artist_alias(spark, str(tmp_path / "0")).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # a file is read in parts by several tasks
    try:
        assert {r.key: r.value for r in tables.read_artist_alias(spark, str(tmp_path / "0")).collect()} == with_parts
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_catalog_out_of_reach_is_not_empty(spark, tmp_path):
    with pytest.raises(Exception, match="nostore"):
        tables.load_catalog(spark, "nostore://somewhere/catalog", "a int")


def test_rename_file_keeps_empty_fields(spark, tmp_path):
    (tmp_path / "r.csv").write_text('a,\n"b, c",d,more\nlone\n')
    assert rows(tables.read_rename_list(spark, str(tmp_path / "r.csv")), "source", "target") == [("a", ""), ("b, c", "d")]


def test_damaged_catalogs_are_empty(spark, tmp_path):
    for kind, name in (("parquet", "part-1.parquet"), ("json", "part-1.json")):
        path = tmp_path / kind
        tables.save_catalog(spark.range(2).selectExpr("cast(id as int) a"), str(path), kind)
        assert rows(tables.load_catalog(spark, str(path), "a int", kind), "a") == [(0,), (1,)]
        (path / name).write_text("{broken")
        assert tables.load_catalog(spark, str(path), "a int", kind).count() == 0


def test_albums_hash_their_folders_below(spark):
    import hashlib

    def f(folder_path, file, h, size=1):
        return (folder_path, file, "." + file.rsplit(".", 1)[1], h, size)

    files = [f("/m/a", "2.mp3", "h2"), f("/m/a/d1", "1.mp3", "h1"), f("/m/a", "cover.jpg", "zz", 50), f("/m/b", "2.MP3", "h2"), f("/m/b/d2", "9.flac", "h1"), f("/m/b", "n.ogg", "qq"), f("/m/c", "x.mp3", None), f("/m", "top.mp3", "t"), f("/mx/a", "2.mp3", "h2"), f("/m/d/e", "y.txt", "y")]
    t = spark.createDataFrame(files, "folder_path string, file string, ext string, file_hash string, size long")
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert rows(d.album_hashes(t, "/m/"), "album_path", "album_hash", "size") == [("/m/a", md5("h2h1"), 52), ("/m/b", md5("h2h1"), 3), ("/m/c", md5(""), 1), ("/m/d", md5(""), 1)]
    assert rows(d.albums_by_size(t, "/m"), "album_path", "kept") == [("/m/b", "/m/a"), ("/m/d", "/m/c")]
    assert rows(c.backup_plan(t, "/m", "/bak/"), "src", "dst") == [("/m/a/2.mp3", "/bak/a/2.mp3"), ("/m/a/d1/1.mp3", "/bak/a/d1/1.mp3"), ("/m/b/2.MP3", "/bak/b/2.MP3"), ("/m/b/d2/9.flac", "/bak/b/d2/9.flac"), ("/m/c/x.mp3", "/bak/c/x.mp3"), ("/m/top.mp3", "/bak/top.mp3")]


def test_files_of_an_album_are_numbered_over_ranges(spark):
    t = spark.createDataFrame([("/m", f"{i:03d}.mp3", {"album": "A" if i % 5 else "B"} if i != 7 else {}) for i in range(100)], "folder_path string, file string, tags map<string,string>")
    got = rows(d.by_album(t, parts=6), "album", "place", "path", "n_files")
    for album, own in (("A", [i for i in range(100) if i % 5 and i != 7]), ("B", list(range(0, 100, 5)))):
        assert [x for x in got if x[0] == album] == [(album, k, f"/m/{i:03d}.mp3", len(own)) for k, i in enumerate(own, 1)]


def test_album_records_fill_files_that_lack_tags(spark):
    t = tracks(spark, folder("/m/x/a", [("1.mp3", "1", 1, {"title": "t"}), ("2.mp3", "2", 1, tags("t", "p", "q"))]), folder("/m/x/b", [("1.mp3", "1", 1, None)]))
    albums = spark.createDataFrame([("/m/x/a", "T", "R", None, "G")], "folder_path string, title string, artist string, album string, genre string")
    assert rows(r.apply_album_tags(t, albums), "folder_path", "file", "title", "artist", "album", "genre") == [
        ("/m/x/a", "1.mp3", "T", "R", "Unknown Album", "G"), ("/m/x/a", "2.mp3", "t", "p", "q", None), ("/m/x/b", "1.mp3", "Unknown Title", "Unknown Artist", "Unknown Album", "Unknown Genre"),
    ]
    assert rows(r.english_names(spark.createDataFrame([("/m", "א.mp3"), ("/m", "a.mp3")], "folder_path string, file string"), stem_only=True), "file") == [("a.mp3",)]


def test_tags_travel_over_passes(spark):
    t = tracks(spark, folder("/m/a", [("1.mp3", "h", 1, {})]), folder("/m/b", [("1.mp3", "h", 1, {"title": "T"})]), folder("/m/c", [("1.mp3", "h", 1, {"title": "T", "genre": "G"})]))
    chosen = spark.createDataFrame([("/m/a", "/m/b", 95.0), ("/m/b", "/m/c", 90.0)], "preferred string, other string, weighted_score double")
    art = spark.createDataFrame([], tables.ART)
    assert rows(q.merge_plan(chosen, t, art), "src", "dst") == [("/m/a/1.mp3", "title=T"), ("/m/b/1.mp3", "genre=G")]
    assert rows(q.merge_plan(chosen, t, art, passes=2), "src", "dst") == [("/m/a/1.mp3", "genre=G"), ("/m/a/1.mp3", "title=T"), ("/m/b/1.mp3", "genre=G")]


def test_chosen_pairs(spark):
    found = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "f")], "a string, b string")
    choices = spark.createDataFrame([("a", "b", 1), ("c", "d", 2), ("e", "f", 0)], "a string, b string, choice int")
    assert rows(q.merge_chosen(found, choices), "action", "src", "dst") == [("merge_dir", "b", "a"), ("merge_dir", "c", "d")]


def test_alias_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Artist1 , Artist One\nartist2,Artist Two\na,b,c\nARTIST2,Last\n")
    assert rows(tables.read_artist_alias(spark, str(tmp_path / "a.csv")), "key", "value") == [("artist1", "Artist One"), ("artist2", "Last")]
    (tmp_path / "e.csv").write_text("")
    assert tables.read_artist_alias(spark, str(tmp_path / "e.csv")).count() == 0


def test_catalog_files(spark, tmp_path):
    assert tables.load_catalog(spark, str(tmp_path / "none"), "a int").count() == 0
    tables.save_catalog(spark.range(2).selectExpr("cast(id as int) a"), str(tmp_path / "c"))
    assert tables.load_catalog(spark, str(tmp_path / "c"), "a int").count() == 2


def test_folders_need_more_than_two_files(spark):
    t = tracks(spark, folder("/m/x/two", [("a.mp3", "1", 1, None), ("b.mp3", "2", 1, None)]), folder("/m/x/three", [(f"{i}.mp3", "1", 1, None) for i in range(3)]))
    assert rows(c.album_folders(t), "folder_path", "n_files") == [("/m/x/three", 3)]


def test_artist_resolution(spark):
    t = tracks(spark, folder("/m/Par/one", [("a.mp3", "1", 1, tags("t", "", "")), ("b.mp3", "2", 1, tags("t", " X ", " Al "))]), folder("/m/Par/two", [("a.mp3", "1", 1, None)]))
    alias = spark.createDataFrame([("x", "The X"), ("par", "The Par"), ("Par", "cased")], tables.ARTIST_ALIAS)
    assert rows(c.resolve_artist(t, alias), "folder_path", "artist", "album") == [("/m/Par/one", "The X", "Al"), ("/m/Par/two", "The Par", None)]
    assert rows(c.resolve_artist_album(t, alias), "folder_path", "artist", "album") == [("/m/Par/one", "cased", "one"), ("/m/Par/two", "cased", "two")]
    assert rows(c.resolve_artist_album(t, alias.where("key = 'x'")).where("album is not null"), "artist", "album") == [("", "")]


def test_empty_folders(spark):
    dirs = spark.createDataFrame([(p, "", "") for p in ("/r", "/r/e", "/r/e/f", "/r/u", "/r/u/v")], "path string, name string, parent_path string")
    files = spark.createDataFrame([("/r/u/v", "x.txt")], "folder_path string, file string")
    assert rows(c.empty_folders(dirs, files, "/r"), "src") == [("/r/e",), ("/r/e/f",)]


def test_keep_one(spark):
    t = tracks(spark, folder("/m/a", [("1.mp3", "h", 128, tags("t", album="A")), ("2.mp3", "h", 320, tags("u", album="A")), ("3.mp3", None, 1, None), ("4.mp3", None, 1, None)]), folder("/m/b", [("1.mp3", "h", 128, tags("t", album="B")), ("2.mp3", "", 1, None), ("3.mp3", "", 1, None)]))
    assert rows(d.in_folder(t), "path", "kept") == [("/m/a/2.mp3", "/m/a/1.mp3"), ("/m/b/3.mp3", "/m/b/2.mp3")]
    assert rows(d.global_best(t), "path", "kept") == [("/m/a/1.mp3", "/m/a/2.mp3"), ("/m/b/1.mp3", "/m/a/2.mp3")]
    assert rows(d.best_per_album(t), "path", "kept") == [("/m/a/1.mp3", "/m/a/2.mp3")]
    assert d.best_per_album(t, per_title=True).count() == 0
    assert rows(r.recycle(d.in_folder(t), "/bin", suffix=True), "dst") == [("/bin/2.mp3",), ("/bin/3.mp3",)]
    assert rows(d.mean_bitrate(tracks(spark, folder("/m/z", [("a.mp3", "h", 0, None), ("b.mp3", "h", 100, None)]))), "mean_kbps") == [(100.0,)]


def test_merge_fills_what_is_lacking(spark):
    t = tracks(
        spark, folder("/m/p", [("1.mp3", "h1", 1, {"title": "", "artist": "own"}), ("2.mp3", None, 1, {})]),
        folder("/m/o", [("1.mp3", "other", 1, {"title": "no"}), ("2.mp3", "zz", 1, {"album": "B"}), ("9.mp3", "h1", 1, {"title": "T", "artist": "theirs", "genre": ""})]),
    )
    chosen = spark.createDataFrame([("/m/p", "/m/o", 90.0)], "preferred string, other string, weighted_score double")
    assert rows(q.matched_files(chosen, t), "file", "match") == [("1.mp3", "9.mp3"), ("2.mp3", "2.mp3")]
    art = spark.createDataFrame([("/m/p", "Cover.jpg", "x"), ("/m/o", "FOLDER.jpg", "y")], tables.ART)
    assert rows(q.merge_plan(chosen, t, art), "action", "src", "dst") == [("copy", "/m/o/FOLDER.jpg", "/m/p/FOLDER.jpg"), ("set_tag", "/m/p/1.mp3", "title=T"), ("set_tag", "/m/p/2.mp3", "album=B")]
    assert rows(q.missing_files(chosen, t), "action", "src") == [("move", "/m/o/9.mp3"), ("rmtree", "/m/o")]
    assert q.merge_plan(chosen.withColumn("weighted_score", F.lit(84.9)), t, art).count() == 0


def test_rename_list(spark):
    lines = [("a", "a"), ("a", "b"), ("a", "c"), ("c", "a"), ("d", "gone"), ("gone", "b"), ("e", "d")]
    renames = spark.createDataFrame([(n, *x) for n, x in enumerate(lines)], "line_no long, source string, target string")
    names = spark.createDataFrame([(x,) for x in "abcde"], "name string")
    children = spark.createDataFrame([("a", "1.mp3"), ("a", "disc"), ("e", "2.mp3"), ("b", "3.mp3")], "name string, child string")
    want = [("merge_dir", "a/1.mp3", "b/1.mp3"), ("merge_dir", "a/disc", "b/disc"), ("merge_dir", "e/2.mp3", "d/2.mp3"), ("rename", "c", "a"), ("rmtree", "a", None), ("rmtree", "e", None)]
    assert rows(r.existing_renames(renames, names, children), "action", "src", "dst") == want


def test_stream_scans_once_and_keeps_first_copies(spark, tmp_path):
    src, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    src.mkdir()
    (src / "a.bin").write_bytes(b"1")
    (src / "b.bin").write_bytes(b"1")
    for more in (None, b"1", b"2"):
        if more:
            (src / f"{more!r}.bin").write_bytes(more)
        incoming.append(incoming.first_copies(incoming.incoming_files(spark, str(src))), str(out), str(state)).awaitTermination()
    assert spark.read.parquet(str(out)).count() == 2


def test_a_streamed_catalog_takes_each_folder_once(spark, tmp_path):
    path = str(tmp_path / "catalog")
    made = lambda *names: spark.createDataFrame([(n, n[1:]) for n in names], "folder_path string, folder_name string")
    told = lambda: rows(spark.read.schema(incoming.catalog_schema(made("/x"))).parquet(path), "folder_path", "batch")
    incoming.add_folders(made("/a", "/b", "/a"), 0, path)
    assert told() == [("/a", 0), ("/b", 0)]
    for _ in range(2):  # a batch that runs twice
        incoming.add_folders(made("/b", "/c"), 1, path)
        assert told() == [("/a", 0), ("/b", 0), ("/c", 1)]
    incoming.add_folders(made("/a", "/c"), 2, path)
    assert told() == [("/a", 0), ("/b", 0), ("/c", 1)]
    incoming.add_folders(made("/b", "/c", "/c"), 1, path)  # again, though a later one is there
    assert told() == [("/a", 0), ("/b", 0), ("/c", 1)]


def test_listings_of_a_large_class(spark):
    t = spark.createDataFrame([(f"/{i:03d}", "n" if i < 90 else "m", f) for i in range(100) for f in ("b", "a" if i % 30 else "c")], "folder_path string, folder_name string, file string")
    classes = {r.path: (r.class_path, r.n_folders) for r in c.listing_classes(t).collect()}
    assert classes == {f"/{i:03d}": ("/000", 3) if i in (0, 30, 60) else ("/001", 87) if i < 90 else ("/090", 1) if i == 90 else ("/091", 9) for i in range(100)}
    assert c.same_listing(t).count() == 3 * 2 + 87 * 86 + 9 * 8
    plan = c.listing_classes(t)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_names_in_a_bin_are_numbered_over_ranges(spark):
    losers = spark.createDataFrame([(f"/{i:03d}", "same.mp3" if i % 4 else f"{i}.mp3") for i in range(80)], "folder_path string, file string")
    got = {x.src: x.dst for x in r.recycle(losers, "/bin", suffix=True).collect()}
    same = [i for i in range(80) if i % 4]
    want = {f"/{i:03d}/same.mp3": "/bin/same.mp3" + (f".{k}" if k else "") for k, i in enumerate(same)} | {f"/{i:03d}/{i}.mp3": f"/bin/{i}.mp3" for i in range(0, 80, 4)}
    assert got == want
