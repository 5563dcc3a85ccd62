"""Content files end to end: parsing, checking, relations, paging, index, changes."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from marlstone import cli
from marlstone.functions.export import static_result, table_definitions, type_definitions
from marlstone.operators import incremental, postings, relations
from marlstone.operators.relations import DanglingKeyError
from marlstone.plans.catalog import Catalog, ConfigError, Relation, Source
from marlstone.plans.engine import Engine, MemoryCache
from marlstone.plans.paging import CursorError, decode_cursor, encode_cursor, page_slice, slice_info
from marlstone.sources import files, parsers
from marlstone.sources.changes import ComparisonChanges, FolderChanges, GitChanges, extract_diff
from marlstone.sources.mini_yaml import ABSENT, parse_front_matter, parse_yaml
from marlstone.sources.storage import CachedStorage, HttpStorage, LocalStorage, RoutedStorage, SparkStorage, prefetch
from marlstone.sources.validation import ValidationError, validate, violations
from marlstone.streaming.updates import follow

TEXT, NUMBER = {"type": "string"}, {"type": "integer"}
TEXTS = {"type": "array", "items": TEXT}


def listed(*required, **properties):
    """A file that holds a list of objects."""
    return {"type": "array", "items": {"type": "object", "required": ["slug", *required], "properties": {"slug": TEXT, **properties}}}


def meets(to, kind, local, foreign):
    return {"to": to, "type": kind, "localKey": local, "foreignKey": foreign}


def meets_twice(to, kind, local, through, entry, exit_, foreign):
    return {"to": to, "type": kind, "through": through, "sourceLocalKey": local, "throughForeignKey": entry, "throughLocalKey": exit_, "targetForeignKey": foreign}


CONFIG = {
    "sources": {
        "studios": {"type": "yaml", "pattern": "studios.yaml", "schema": listed("city", city=TEXT, rooms=NUMBER)},
        "people": {"type": "json", "pattern": "people.json", "schema": listed("name", name=TEXT), "index": {"name": {}}},
        "albums": {
            "type": "yaml", "pattern": "albums.yaml", "index": {"name": {"indexDepth": 3}, "players.slug": {}},
            "schema": listed("name", name=TEXT, studio=TEXT, credits={"type": "array", "items": {"type": "object", "properties": {"role": TEXT, "who": TEXT}}}),
            "relations": {
                "tracks": meets("tracks", "belongsToMany", "slug", "album"),
                "crew": meets("people", "hasMany", "credits.who", "slug"),
                "players": meets_twice("people", "hasManyThrough", "slug", "tracks", "album", "performers", "slug"),
            },
        },
        "tracks": {
            "type": "markdown", "pattern": "tracks/**/*.md", "index": {"title": {}, "moods": {"indexDepth": 2}},
            "schema": {"type": "object", "required": ["title", "album"], "properties": {"title": TEXT, "album": TEXT, "performers": TEXTS, "moods": TEXTS, "seconds": NUMBER, "memo": TEXT}},
            "relations": {
                "on": meets("albums", "hasOne", "album", "slug"),
                "players": meets("people", "hasMany", "performers", "slug"),
                "place": meets_twice("studios", "hasOneThrough", "album", "albums", "slug", "studio", "slug"),
            },
        },
        "about": {"type": "json", "pattern": "about.json", "schema": {"type": "object", "properties": {"slug": TEXT, "motto": TEXT}}},
    }
}
FILES = {
    "studios.yaml": "# where albums were made\n- slug: north\n  city: Tromsø\n  rooms: 2\n- slug: quay\n  city: Lisboa\n  rooms: 11\n",
    "people.json": json.dumps([{"slug": s, "name": n} for s, n in (("ines", "Inês"), ("otto", "Otto"), ("yun", "윤서"))]),
    "albums.yaml": "- slug: first\n  name: First Light\n  studio: quay\n  credits:\n    - role: mix\n      who: yun\n    - role: sleeve\n      who: nobody\n- slug: second\n  name: Second Tide\n  studio: shut\n- slug: third\n  name: Third Rail\n",
    "tracks/first/ember.md": "---\ntitle: Ember Road\nalbum: first\nperformers:\n  - ines\n  - otto\nmoods: [slow,\n  warm]\nmemo:\n---\nliner notes\n",
    "tracks/first/glass.md": "---\ntitle: Żuraw\nalbum: first\nseconds: 181\n\nperformers: [otto, ghost]\nmoods: [slow]\n---\n",
    "tracks/second/harbour.md": "---\ntitle: Évora\nalbum: second\nperformers: []\n---\n",
    "tracks/loose.md": "---\ntitle: übung\nalbum: unreleased\n---\n",
    "about.json": '{"motto": "Play it twice"}',
}


def write(root, files=FILES):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")
    return str(root)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return write(tmp_path_factory.mktemp("content"))


@pytest.fixture(scope="module")
def engine(spark, root):
    return Engine(spark, Catalog.from_json(CONFIG), root)


def slugs(page):
    return [r.slug for r in page.data.collect()]


EMBER, GLASS, HARBOUR = "first--ember", "first--glass", "second--harbour"


def test_filters(engine):
    tracks = engine.from_("tracks")
    assert slugs(tracks.where("title", "eq", "Żuraw").exec()) == [GLASS]
    assert slugs(tracks.where("moods", "in", ["warm", "slow"]).exec()) == [EMBER, GLASS]
    assert slugs(tracks.where("moods", "eq", "slow").where("title", "startsWith", "Em").exec()) == [EMBER]
    assert slugs(tracks.where("moods", "eq", "warm").where("title", "startsWith", "Ż").exec()) == []
    assert slugs(tracks.where("moods", "eq", "warm").where("title", "startsWith", "Ż").either().exec()) == [EMBER, GLASS]
    assert slugs(tracks.where("slug", "in", ["loose", "nowhere"]).exec()) == ["loose"]
    assert slugs(engine.from_("albums").where("players.slug", "in", ["otto", "yun"]).exec()) == ["first"]


def test_order_and_default_page(engine):
    page = engine.from_("tracks").exec()
    assert slugs(page) == [EMBER, GLASS, "loose", HARBOUR] and page.page_info.to_json().keys() >= {"startCursor", "endCursor"}
    assert not page.page_info.has_next and not page.page_info.has_previous
    assert slugs(engine.from_("tracks").order_by("title").exec()) == [EMBER, HARBOUR, "loose", GLASS]  # as people sort, accents last
    assert slugs(engine.from_("tracks").order_by("title", "desc").exec()) == [GLASS, "loose", HARBOUR, EMBER]
    assert slugs(engine.from_("tracks").order_by("title").collate("BINARY").exec()) == [EMBER, HARBOUR, "loose", GLASS]
    assert slugs(engine.from_("tracks").order_by("moods").exec()) == [EMBER, GLASS]  # no value, no line; several lines, one record


def test_relations_of_files(engine):
    tracks = {r.slug: r for r in engine.from_("tracks").join("on").join("players").join("place").exec().data.collect()}
    assert [p.name for p in tracks[EMBER].players] == ["Inês", "Otto"] and tracks[HARBOUR].players == []
    assert [p.slug for p in tracks[GLASS].players] == ["otto"]  # the dangling key is dropped
    assert tracks[GLASS].on.name == "First Light" and tracks["loose"].on is None
    assert tracks[EMBER].place.city == "Lisboa" and tracks[HARBOUR].place is None and tracks["loose"].place is None
    albums = {r.slug: r for r in engine.from_("albums").join("tracks").join("crew").join("players").exec().data.collect()}
    assert {k: [t.slug for t in r.tracks] for k, r in albums.items()} == {"first": [EMBER, GLASS], "second": [HARBOUR], "third": []}
    assert [p.slug for p in albums["first"].players] == ["ines", "otto", "otto"] and albums["third"].players == []
    assert [p.slug for p in albums["first"].crew] == ["yun"] and albums["second"].crew == []
    strict = Engine(engine.spark, engine.catalog, engine.root, strict=True)
    with pytest.raises(DanglingKeyError):
        strict.from_("tracks").join("players").exec()


def test_records(engine):
    found = engine.from_("tracks").find(GLASS)
    assert found.seconds == 181 and found.raw.startswith("---") and found.performers[-1] == "ghost"
    assert engine.from_("about").find("about").motto == "Play it twice"
    with pytest.raises(LookupError):
        engine.from_("tracks").find("nowhere")
    assert [r.slug for r in engine.get_many("people", ["yun", "ines", "yun"]).collect()] == ["yun", "ines"]
    with pytest.raises(LookupError, match="Failed to load by slug"):
        engine.get_many("people", ["yun", "nobody"])
    assert engine.from_("tracks").peek().data.columns == ["v", "vs", "slug"]


def test_messages(engine):
    with pytest.raises(ConfigError, match="Source not found: labels"):
        engine.from_("labels")
    with pytest.raises(ConfigError, match=r"\[tracks\] needs index: .*memo"):
        engine.from_("tracks").where("memo", "eq", "x").exec()
    with pytest.raises(ConfigError, match=r"\[tracks\] needs index: seconds"):
        engine.from_("tracks").order_by("seconds").exec()
    with pytest.raises(ConfigError, match="Unknown relation: covers"):
        engine.from_("tracks").join("covers")
    with pytest.raises(CursorError, match="Invalid cursor"):
        engine.from_("tracks").cursor("%%")
    with pytest.raises(ValueError, match="No parser registered for type: toml"):
        parsers.parse("toml", "")
    with pytest.raises(ConfigError, match=r"out of range \(1-10\)"):
        Catalog.from_json({"sources": {"a": {"type": "json", "pattern": "a", "index": {"x": {"indexDepth": 0}}}}})


def test_bad_records(spark, tmp_path):
    catalog = Catalog.from_json({"sources": {"pins": {"type": "markdown", "pattern": "pins/*.md", "schema": {"type": "object", "required": ["lat"], "properties": {"lat": {"type": "number"}}}}}})
    write(tmp_path, {"pins/here.md": "---\nslug: elsewhere\nlat: 4.5\n---\n"})
    with pytest.raises(Exception, match="Slug mismatch"):
        Engine(spark, catalog, str(tmp_path)).frame("pins").collect()
    write(tmp_path, {"pins/here.md": "---\nlong: 3\n---\n"})
    with pytest.raises(Exception, match="Missing required field"):
        Engine(spark, catalog, str(tmp_path)).frame("pins").collect()


def test_slugs_and_integers_are_exact(spark):
    rows = [(7, 1, "a"), (21, 2, "b"), (-5, 3, "c")]
    catalog = Catalog({
        "t": Source("t", "table", "", key=("id",), index={"n": 1}),
        "pair": Source("pair", "table", "", key=("id", "n")),
    })
    df = spark.createDataFrame(rows, "id int, n long, w string")
    e = Engine(spark, catalog, frames={"t": df, "pair": df})
    for odd in ("007", "+7", " 7", "7.0", "--5", "²", "-", "", "99999999999999999999", "3000000000"):
        assert slugs(e.from_("t").where("slug", "eq", odd).exec()) == [] and slugs(e.from_("t").where("n", "in", [odd, "2"]).exec()) == ["21"]
        assert e.by_slugs("t", [odd]).count() == 0
        with pytest.raises(LookupError):
            e.from_("t").find(odd)
    assert e.from_("t").find("-5").w == "c" and e.from_("pair").find("-5--3").w == "c" and e.by_slugs("pair", ["7--1", "7--2", "07--1", "7"]).count() == 1


def test_slugs_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS n").write.parquet(str(tmp_path / "t.parquet"))
    catalog = Catalog({"t": Source("t", "table", "t.parquet", key=("id",)), "pair": Source("pair", "table", "t.parquet", key=("id", "n"))})
    e = Engine(spark, catalog, str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "PushedFilters: [In(id, [21,7])]" in plan(e.from_("t").where("slug", "in", ["7", "21"]).to_df())
    assert "EqualTo(id,7)" in plan(e.from_("pair").where("slug", "eq", "7--0").to_df())
    assert [r.slug for r in e.from_("pair").where("slug", "in", ["7--0", "8--0"]).to_df().collect()] == ["7--0"]
    pairs = relations.linked(e.frame("t"), Relation("t", "hasOne", "n", "slug"), e.frame("t"))
    assert "Generate" not in plan(pairs) and "cast(id" not in plan(pairs).split("== Physical Plan ==")[1].split("Join")[0].lower().split("condition")[-1]
    assert pairs.count() == 100


def test_pages_chain(spark):
    rows = [(i, [f"v{i % 4}", f"w{i % 3}"], f"k{i % 5}") for i in range(37)]
    catalog = Catalog({"t": Source("t", "table", "", key=("i",), index={"many": 1, "k": 1})})
    e = Engine(spark, catalog, frames={"t": spark.createDataFrame(rows, "i long, many array<string>, k string")})
    for key, direction in (("slug", "asc"), ("k", "desc"), ("many", "asc")):
        q = e.from_("t").order_by(key, direction).page_size(10)
        whole = [tuple(r) for r in q.page_size(1000).peek().data.collect()]
        seen, page = [], q.peek()
        while True:
            seen += [tuple(r) for r in page.data.collect()]
            if not page.page_info.has_next:
                break
            page = q.cursor(page.page_info.end_cursor).peek()
            assert page.page_info.has_previous
        assert seen == whole
        back = q.cursor(encode_cursor({key: whole[20][0]}, whole[20][2]), "before").peek()
        assert [tuple(r) for r in back.data.collect()] == whole[10:20] and back.page_info.has_next and back.page_info.has_previous
        last = q.last_page().peek()
        assert [tuple(r) for r in last.data.collect()] == whole[-10:] and not last.page_info.has_next
    q = e.from_("t")
    assert sorted(slugs(q.where("k", "eq", "k1").page_size(99).exec())) == sorted(slugs(q.where("k", "in", ["k1"]).page_size(99).exec()))


def test_cursors_and_slices():
    assert decode_cursor(encode_cursor({"title": "Żu"}, "a--b")) == ({"title": "Żu"}, "a--b")
    for bad in ("", "x", "e30=", encode_cursor({}, "a")[:-3]):
        with pytest.raises(CursorError):
            decode_cursor(bad)
    rows = list("abcdefgh")
    assert [page_slice(rows, s, 3, "after") for s in (0, 2)] == [list("abc"), list("def")] and page_slice([], 0, 3, "after") == []
    assert page_slice(rows, 6, 3, "before") == list("def") and page_slice(rows, 2, 5, "before") == list("ab")
    flags = lambda start, total, d, page="abc": (lambda i: (i.has_next, i.has_previous))(slice_info(list(page), 3, start, total, d, str))
    assert [flags(0, 10, "after"), flags(0, 3, "after"), flags(3, 10, "after"), flags(6, 10, "after"), flags(0, 0, "after", "")] == [(True, False), (False, False), (True, True), (False, True), (False, False)]
    assert [flags(10, 10, "before"), flags(6, 10, "before"), flags(3, 10, "before")] == [(False, True), (True, True), (True, False)]


def test_yaml():
    assert parse_yaml("mass: -0.50\nsite: ftp://host:21/x\nat: 07:45\nopen: false\nowner: null\nborn: 1999-12-31\nq: \"kept\"\nbig: 12345678901234567890") == {
        "mass": -0.5, "site": "ftp://host:21/x", "at": "07:45", "open": False, "owner": None, "born": "1999-12-31", "q": '"kept"', "big": 1.2345678901234567e19
    }
    assert parse_yaml("even: [2, \"4\", , '6' ]\nodd: [one,\n\n  three\n  ]\nnone: []") == {"even": ["2", "4", "6"], "odd": ["one", "three"], "none": []}
    assert parse_yaml("blank:\nfull: 1")["blank"] is ABSENT and parse_yaml("") == {} == parse_yaml("# only this\n\nwords")
    assert parse_yaml("- kind: oak\n  rings:\n    - year: 1900\n      width: 2.5\n\n    # a dry one\n    - year: 1901\n- kind: elm") == [
        {"kind": "oak", "rings": [{"year": 1900, "width": 2.5}, {"year": 1901}]}, {"kind": "elm"}
    ]
    assert parse_yaml("a:\n  b:\n    c:\n      - x\n      - y\n  d: 1\ne: 2") == {"a": {"b": {"c": ["x", "y"]}, "d": 1}, "e": 2}
    assert parse_yaml("gone: 1\nlist:\n- p\n- q") == ["p", "q"]  # items at the indentation of their key take the map's place
    assert parse_yaml("k:\r\n  [m,\r\n   n]\r\n") == {"k": ["m", "n"]} and parse_yaml("deep: 3\n    er: 4") == {"deep": {"er": 4}}
    assert parse_front_matter("body only") == {} and parse_front_matter("---\nnever: closed") == {} and parse_front_matter("---\n- z: 9\n- z: 8\n---\ntext") == {"z": 9}


@pytest.mark.parametrize(
    "fine, schema, values",
    [
        (True, {"type": "string"}, ["", "north"]), (False, {"type": "string"}, [7, None, ["north"]]), (True, {"type": "number"}, [7, 7.25, -1e9]), (False, {"type": "number"}, ["7", False]),
        (True, {"type": "integer"}, [12, 12.0]), (False, {"type": "integer"}, [12.5, "12"]), (True, {"type": ["integer", "null"]}, [None, 4]), (False, {"type": ["boolean", "integer"]}, ["yes", 0.5]),
        (True, {"type": "array", "items": TEXT}, [[], ["a", "b"]]), (False, {"type": "array", "items": TEXT}, ["a", ["a", 1]]), (False, {"type": ["boolean", "array"]}, [True]),
        (True, {"type": "object"}, [{}, {"any": object()}]), (False, {"type": "object", "required": ["lat"]}, [{}, {"long": 1}, []]), (True, {"type": "object", "required": ["lat"], "properties": {"lat": NUMBER}}, [{"lat": ABSENT}, {"lat": 3}]),
        (False, {"type": "object", "properties": {"at": {"type": "object", "required": ["lat"]}}}, [{"at": {"long": 2}}]), (True, {}, [object(), None, 3]), (True, {"type": "string", "enum": ["east"]}, ["west"]),
        (True, {"type": "date"}, ["1999-12-31", "1999-12-31T23:59:00Z", "December 31, 1999"]), (False, {"type": "date"}, ["tomorrow", 1999, ""]),
    ],
)
def test_validation(fine, schema, values):
    for value in values:
        if fine:
            validate(value, schema)
        else:
            with pytest.raises(ValidationError):
                validate(value, schema)


def test_required_values_inside_lists_and_objects_of_a_table(spark):
    schema = {"type": "object", "properties": {
        "at": {"type": "object", "required": ["lat"], "properties": {"lat": {"type": "number"}}},
        "stops": {"type": "array", "items": {"type": "object", "required": ["name"], "properties": {"name": TEXT}}},
    }}
    rows = [("whole", (1.0,), [("a",)]), ("no lat", (None,), []), ("none", None, None), ("no name", (2.0,), [("a",), (None,)])]
    df = spark.createDataFrame(rows, "slug string, at struct<lat double>, stops array<struct<name string>>")
    assert sorted(map(tuple, violations(df, schema).collect())) == [("no lat", "at.lat", "missing"), ("no name", "stops.name", "missing")]


class Shelf(MemoryCache):
    asked = 0

    def get(self, name):
        self.asked += 1
        return super().get(name)


def test_injection(spark, tmp_path):
    class Said:
        """A logger that can go to executors and says on the driver what was logged there."""

        def __init__(self, path):
            self.path = path

        def info(self, message, *args):
            with open(self.path, "a") as out:
                out.write(message % args + "\n")

        warning = info

    write(tmp_path, {"d/rows.tsv": "slug\tplant\nx\talder\ny\tbirch\nz\tcedar\n"})
    catalog = Catalog.from_json({"sources": {"rows": {"type": "tsv", "pattern": "d/*.tsv", "customIndex": {"loud": {}, "parts": {}}, "schema": {"type": "object", "properties": {"slug": TEXT, "plant": TEXT}}}}})

    def tsv(text):
        head, *lines = [line.split("\t") for line in text.splitlines()]
        return [dict(zip(head, line, strict=True)) for line in lines]

    def parts(record):
        if record["slug"] == "y":
            raise KeyError("no parts")
        return [record["plant"][:2], None, len(record["plant"]), 2.0, True] if record["slug"] == "x" else None

    shelf = Shelf()
    e = Engine(spark, catalog, str(tmp_path), parsers={"tsv": tsv}, custom_index={"rows.loud": lambda df: F.upper("plant")}, record_index={"rows.parts": parts}, logger=Said(str(tmp_path / "log")), cache=shelf)
    assert slugs(e.from_("rows").where("loud", "startsWith", "BI").exec()) == ["y"]
    assert [r.p for r in postings.field_postings(e, "rows", "loud", 1).orderBy("v").collect()] == ["0041", "0042", "0043"]
    assert slugs(e.from_("rows").where("parts", "in", ["5", "al"]).exec()) == ["x"] and "parts" not in e.frame("rows").columns
    assert sorted(r.v for r in postings.field_postings(e, "rows", "parts", 1).collect()) == ["2", "5", "al", "true"]
    said = (tmp_path / "log").read_text()
    assert "custom index rows.parts skips record y: KeyError('no parts')" in said and "record x" not in said
    assert e.prefetch("rows") == 3 and shelf.has("rows") and shelf.asked > 0 and "caching source rows" in (tmp_path / "log").read_text()
    e.evict("rows")
    assert not shelf.has("rows")


def test_line_files(spark, tmp_path):
    write(tmp_path, {"a.jsonl": '{"n": 1, "w": "x"}\n\n   \n{"n": 2}', "b.list": "one\n\n  \ntwo  \nthree"})
    assert [tuple(r) for r in files.json_lines(spark, str(tmp_path / "a.jsonl"), "n int, w string").orderBy("n").collect()] == [(1, "x"), (2, None)]
    assert sorted(r.value for r in files.text_lines(spark, str(tmp_path / "b.list")).collect()) == ["one", "three", "two  "]


def shown(rows):
    return sorted(tuple(r) for r in rows.select("source", "field", "p", "v", "vs", "slug", F.to_json("ref").alias("ref")).collect())


def test_index_round_trip_and_changes(spark, tmp_path):
    root, out = write(tmp_path / "c"), str(tmp_path / "index")
    make = lambda: Engine(spark, Catalog.from_json(CONFIG), root)
    postings.build_index(make(), out)
    rows = postings.read_index(spark, out)
    assert {(r.v, r.slug) for r in postings.probe(rows, "tracks", "moods", "eq", "slow", 2).collect()} == {("slow", EMBER), ("slow", GLASS)}
    assert {r.slug for r in postings.probe(rows, "tracks", "title", "startsWith", "É").collect()} == {HARBOUR}
    assert {(r.v, r.vs, r.slug) for r in postings.probe(rows, "albums", "players.slug", "in", ["otto", "zz"]).collect()} == {("otto", "otto", "first")}
    plan = postings.probe(rows, "tracks", "moods", "eq", "slow", 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and "EqualTo(v,slow)" in plan
    old = make()
    before = {n: spark.createDataFrame(old.frame(n).collect(), old.frame(n).schema) for n in old.catalog}  # the files change below
    write(tmp_path / "c", {"tracks/first/glass.md": "---\ntitle: Glass\nalbum: second\nperformers: [ines]\nmoods: [warm]\n---\n", "tracks/third/rail.md": "---\ntitle: Rail\nalbum: third\nperformers: [otto]\n---\n"})
    (tmp_path / "c/tracks/loose.md").unlink()
    new, feed = make(), None
    for name in ("tracks", "albums", "people"):
        fields = [f for f in new.catalog.indexes(name) if f.partition(".")[0] not in new.catalog[name].relations]
        part = incremental.snapshot_diff(before[name], new.frame(name), name, fields)
        feed = part if feed is None else feed.union(part)
    assert {(r.status, r.slug) for r in feed.collect()} == {("A", "third--rail"), ("D", "loose"), ("M", GLASS)}
    places = {tuple(r) for r in incremental.apply_changes(new, out, feed, str(tmp_path / "staging")).collect()}
    assert ("albums", "players.slug", "006f") in places and ("tracks", "title", "00fc") in places  # albums change with their tracks
    fresh = str(tmp_path / "fresh")
    postings.build_index(new, fresh)
    assert shown(postings.read_index(spark, out)) == shown(postings.read_index(spark, fresh))
    assert not list((tmp_path / "index").rglob("p=00fc"))
    feed.write.json(str(tmp_path / "feeds"))  # again, as a stream: nothing changes
    follow(new, str(tmp_path / "feeds"), out, str(tmp_path / "cp"), str(tmp_path / "staging2")).awaitTermination()
    assert shown(postings.read_index(spark, out)) == shown(postings.read_index(spark, fresh))
    postings.export_lines(postings.read_index(spark, out), str(tmp_path / "export"))
    assert postings.manifest(spark, str(tmp_path / "export"), "*.json.gz").count() > 10
    lines = spark.read.json(str(tmp_path / "export/source=tracks/field=moods"))
    assert {r.vs for r in lines.where("v = 'warm'").collect()} == {EMBER, GLASS}


def test_manifest_is_one_json_array(spark, tmp_path):
    write(tmp_path, {f"x/{n} é.json": "{}" for n in range(30)})
    (tmp_path / "empty").mkdir()
    for folder, n in (("x", 30), ("empty", 0)):
        postings.write_manifest(spark, str(tmp_path / folder), str(tmp_path / f"m-{folder}"))
        whole = json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / f"m-{folder}")).collect()))
        assert len(whole) == n and whole == sorted(whole) and sorted(whole) == sorted(r.file for r in postings.read_manifest(spark, str(tmp_path / f"m-{folder}")).collect())


def test_diff_providers(spark, tmp_path):
    old, new, catalog = tmp_path / "old", tmp_path / "new", Catalog.from_json(CONFIG)
    write(old), write(new)
    edits = {
        "tracks/first/ember.md": FILES["tracks/first/ember.md"].replace("memo:", "memo: louder"), "tracks/fourth.md": "---\ntitle: Fourth\nalbum: third\n---\n",
        "albums.yaml": FILES["albums.yaml"] + "- slug: live\n  name: Live\n", "tracks/second/harbour.md": "---\ntitle: Setúbal\nalbum: second\n---\n",
    }
    (new / "tracks/loose.md").unlink()
    write(new, edits)
    want = {("D", "tracks", "loose"), ("A", "tracks", "fourth"), ("A", "albums", "live"), ("M", "tracks", HARBOUR)}
    got = extract_diff(spark, catalog, FolderChanges(spark), str(old), str(new)).collect()
    assert {(r.status, r.source, r.slug) for r in got} == want and next(r for r in got if r.status == "M").fields["title"] == ["Évora"]
    repo = tmp_path / "repo"
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@e.com", *a], check=True, capture_output=True)
    write(repo)
    git("init", "-q"), git("add", "-A"), git("commit", "-qm", "before"), git("tag", "before")
    (repo / "tracks/loose.md").unlink()
    write(repo, edits)
    git("add", "-A"), git("commit", "-qm", "after")
    assert {(r.status, r.source, r.slug) for r in extract_diff(spark, catalog, GitChanges(str(repo)), "before", "HEAD").collect()} == want
    pages = {"cmp/a...b": json.dumps({"files": [{"status": "added", "filename": "tracks/fourth.md"}, {"status": "renamed", "filename": "y"}]}), "raw/b/tracks/fourth.md": edits["tracks/fourth.md"]}
    web = ComparisonChanges("cmp/{base}...{head}", "raw/{revision}/{path}", fetch=pages.__getitem__)
    assert {(r.status, r.slug) for r in extract_diff(spark, catalog, web, "a", "b").collect()} == {("A", "fourth")}


def test_storage(spark, root, tmp_path):
    class Opened:
        def __init__(self, body):
            self.body = body

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self):
            return self.body

    def opener(request, timeout):
        import gzip
        import urllib.error

        pages = {"http://u/a.txt.gz": gzip.compress(b"zipped"), "http://u/b.txt": b"plain", "http://u/manifest.json": b'["x/a.md", "b.txt"]'}
        if request.full_url not in pages:
            raise urllib.error.URLError("none")
        return Opened(pages[request.full_url])

    web = HttpStorage("http://u", compressed=True, opener=opener)
    assert (web.read("a.txt"), web.read("b.txt"), web.list("x/*.md"), web.exists("b.txt"), web.exists("c")) == ("zipped", "plain", ["x/a.md"], True, False)
    with pytest.raises(PermissionError):
        web.write("a", "b")
    local = LocalStorage(str(tmp_path / "s"))
    for storage in (local, SparkStorage(spark, f"file://{tmp_path}/spark")):
        storage.write("a/b.md", "text")
        storage.write("a/c/d.md", "more")
        assert storage.list("a/*.md") == ["a/b.md"] and storage.list("a/**/*.md") == ["a/b.md", "a/c/d.md"] and storage.read("a/b.md") == "text"
        storage.remove("a/b.md")
        storage.remove_dir("a/c")
        assert not storage.exists("a/b.md") and not storage.exists("a/c/d.md")
        with pytest.raises(FileNotFoundError):
            storage.read("a/b.md")
    routed = RoutedStorage({"web/*": web, "tracks/**/*.md": LocalStorage(root)}, writes=local)
    assert routed.list("tracks/**/*.md")[0] == "tracks/first/ember.md"
    with pytest.raises(LookupError):
        routed.read("other")
    cached = CachedStorage(local, "v1", str(tmp_path / "cache"))
    cached.write("k", "one")
    assert cached.read("k") == "one"
    local.write("k", "two")
    assert cached.read("k") == "one" and CachedStorage(local, "v1", str(tmp_path / "cache")).read("k") == "one"
    assert CachedStorage(local, "v2", str(tmp_path / "cache")).read("k") == "two"
    cached.write("k", "three")
    assert cached.read("k") == "three" and prefetch(cached, ["k", "none"]) == 1


def test_listing_by_a_served_index(spark, root, tmp_path):
    import io
    import urllib.error

    engine = Engine(spark, Catalog.from_json(CONFIG), root)
    postings.export_lines(postings.with_ref(postings.postings(engine, "tracks")), str(tmp_path / "index"))
    listed = postings.manifest(spark, str(tmp_path / "index"), "*.json.gz").collect()
    (tmp_path / "index/manifest.json").write_text(json.dumps([r.file for r in listed]))

    def opener(request, timeout):
        file = tmp_path / request.full_url.removeprefix("http://u/")
        if not file.exists():
            raise urllib.error.URLError("none")
        return io.BytesIO(file.read_bytes())

    web = HttpStorage("http://u", opener=opener, catalog=engine.catalog)
    assert web.list("tracks/**/*.md") == ["tracks/first/ember.md", "tracks/first/glass.md", "tracks/loose.md", "tracks/second/harbour.md"]
    assert web.list("people.json") == ["people.json"]
    with pytest.raises(urllib.error.URLError):
        web.list("other/*.md")


def test_cache_of_sources(engine):
    assert engine.prefetch("studios", "people") == 5 and engine.cache("people").storageLevel.useMemory
    engine.evict("studios"), engine.evict("people")


def test_exports(engine):
    rows = {r.kind: r.value for r in static_result(engine, lambda e: e.from_("people").page_size(1)).collect()}
    assert json.loads(rows["record"])["slug"] == "ines" and json.loads(rows["pageInfo"])["hasNextPage"] and rows["generatedAt"].endswith("Z")
    text = type_definitions(engine.catalog)
    module = {}
    exec(text, module)  # noqa: S102  it is Python
    assert "players: \"NotRequired[list[PeopleRecord]]\"" in text and "AlbumsRelation_players = dict[str, \"list[str]\"]" in text and "moods: \"NotRequired[Annotated[list[str], INDEX]]\"" in text
    assert table_definitions(engine.catalog)["tracks"].startswith("slug STRING NOT NULL, title STRING, album STRING, performers ARRAY<STRING>, moods ARRAY<STRING>, seconds BIGINT")


def test_command_line(spark, root, tmp_path):
    config = tmp_path / "config.json"
    config.write_text(json.dumps(CONFIG), encoding="utf-8")
    assert cli.main([]) == 1 and cli.main(["index", str(config), str(tmp_path / "o"), "--incremental"]) == 1
    assert cli.main(["schema", str(config), str(tmp_path)]) == 0 and (tmp_path / "record_types.py").exists()
    out = str(tmp_path / "index")
    assert cli.main(["index", str(config), out, "--root", root, "--export", str(tmp_path / "e"), "--manifest", str(tmp_path / "m")], spark) == 0
    assert postings.read_manifest(spark, str(tmp_path / "m")).count() > 10
    feed = tmp_path / "feed.json"
    feed.write_text('{"status": "M", "source": "tracks", "slug": "first--glass", "fields": {}}\n')
    before = shown(postings.read_index(spark, out))
    assert cli.main(["index", str(config), out, "--root", root, "--incremental", "--diff-file", str(feed)], spark) == 0
    assert shown(postings.read_index(spark, out)) == before


def test_relation_declarations():
    with pytest.raises(ConfigError):
        Relation("a", "hasSome", "x", "y")
    with pytest.raises(ConfigError):
        Relation("a", "hasOneThrough", "x", "y")
    with pytest.raises(ConfigError, match="Source not found: b"):
        Catalog({"a": Source("a", "json", "a", relations={"b": Relation("b", "hasOne", "x", "slug")})})
