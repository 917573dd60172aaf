import pytest

from kinweave import profiles, schemas
from kinweave.sources import tables


def csv(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_null_words_and_types(spark, tmp_path):
    path = csv(tmp_path / "t.csv", 'id,name,flag,score,extra\n007,王小明,True,1.5,x\n8,N/A,false,bad,\n9,"a, ""b""\nc",,NULL,nan\n')
    raw = tables.read_csv(spark, path).collect()
    assert [r.id for r in raw] == ["007", "8", "9"]
    assert raw[1].name is None and raw[2].name == 'a, "b"\nc'
    typed = tables.read_csv(spark, path, "id string, name string, flag boolean, score double, missing int").collect()
    assert [(r.flag, r.score, r.missing) for r in typed] == [(True, 1.5, None), (False, None, None), (None, None, None)]


def test_missing_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path), "nothing")
    assert tables.read_optional(spark, str(tmp_path), "nothing") is None
    assert tables.read_optional(spark, str(tmp_path), "nothing", "a int").count() == 0


def test_sources_by_role(spark, tmp_path):
    full, delta = tmp_path / "full", tmp_path / "delta"
    full.mkdir()
    delta.mkdir()
    csv(full / "beta_policy.csv", "policy_id\nP1\nP2\n")
    csv(full / "beta_link.csv", "a\n1\n")
    csv(delta / "beta_policy.csv", "policy_id\nP3\n")
    s = tables.Sources(spark, str(full), str(delta))
    assert [r[0] for r in s.changed("Beta", "policy").collect()] == ["P3"]
    assert s.whole("Beta", "policy").count() == 2
    assert s.changed("Beta", "link") is None and s.bridge("Beta", "link").count() == 1
    assert tables.Sources(spark, str(full)).changed("Beta", "policy").count() == 2


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_writes_swap_and_may_read_what_they_replace(spark, tmp_path, fmt):
    folder = str(tmp_path)
    tables.write_table(spark.range(3).selectExpr("cast(id as string) id"), folder, "t", fmt)
    tables.write_table(tables.read_table(spark, folder, "t").filter("id > 0"), folder, "t", fmt)
    assert sorted(r[0] for r in tables.read_table(spark, folder, "t").collect()) == ["1", "2"]


def test_profiled_tables_and_delta(spark, tmp_path):
    folder = str(tmp_path)
    tables.write_profiled(spark.range(1), folder, "m", profiles.DEFAULT)
    tables.write_profiled(spark.range(2), folder, "m", profiles.ANALYTICS)
    count = lambda p: tables.read_profiled(spark, folder, "m", p).count()
    assert [count(p) for p in (profiles.DEFAULT, profiles.ANALYTICS, profiles.OPERATIONAL)] == [1, 2, 1]
    assert tables.write_delta({"a": spark.range(1), "b": spark.range(0)}, folder) == ["a"]


def test_profiles(tmp_path):
    assert profiles.list_profiles() == ["analytics", "default", "operational"]
    assert profiles.list_profiles(str(tmp_path / "none")) == []
    (tmp_path / "resolution_strict.yaml").write_text("# c\nname: \"strict\"\nmerge_threshold: 0.9  # high\nhard_link_tier1_ratio: 0.9\nuse_hard_links_only: true\nunknown: 3\n")
    strict = profiles.load_profile("strict", str(tmp_path))
    assert (strict.name, strict.merge_threshold, strict.use_hard_links_only, strict.output_suffix) == ("strict", 0.9, True, "_strict")
    assert profiles.list_profiles(str(tmp_path)) == ["strict"]
    for bad in ({"merge_threshold": 1.2}, {"hard_link_tier1_ratio": 0.2}, {"hard_link_tier3_ratio": 0.4}):
        with pytest.raises(ValueError):
            profiles.Profile(**bad)
    with pytest.raises(FileNotFoundError):
        profiles.load_profile("other")
    with pytest.raises(FileNotFoundError):
        profiles.load_profile("other", str(tmp_path))


def test_catalogue_switches_profiles(spark, tmp_path):
    folders = [tmp_path / n for n in ("metadata", "bronze", "silver", "gold")]
    for f in folders:
        f.mkdir()
    empty = lambda n: spark.createDataFrame([], schemas.GOLD[n])
    for n in schemas.GOLD:
        tables.write_profiled(empty(n), str(folders[3]), n)
    one = spark.createDataFrame([("E1",) + (0,) * 6 + (0.0,) * 3 + (0, 0) + (0.0, 0.0) + (None, None, True)], schemas.MASTER_ENTITY)
    tables.write_profiled(one, str(folders[3]), "master_entity", profiles.ANALYTICS)
    c = tables.Catalogue(spark, *map(str, folders))
    assert c["master_entity"].count() == 0
    c.switch("analytics")
    assert spark.table("master_entity").count() == 1 and c["party_to_entity_link"].count() == 0
    with pytest.raises(ValueError):
        c.switch("nope")
    assert c.profile.name == "analytics"


@pytest.mark.parametrize("dies_at", [1, 2])
def test_a_write_that_dies_keeps_the_table(spark, tmp_path, monkeypatch, dies_at):
    folder = str(tmp_path)
    tables.write_table(spark.range(3), folder, "t")
    moves, move = [], tables._move

    def dying(*args):
        moves.append(args)
        if len(moves) == dies_at:
            raise OSError("gone")
        move(*args)

    with monkeypatch.context() as m:
        m.setattr(tables, "_move", dying)
        with pytest.raises(OSError):
            tables.write_table(spark.range(9), folder, "t")
    assert tables.read_optional(spark, folder, "t", "id long").count() == 3
    tables.write_table(tables.read_table(spark, folder, "t").filter("id > 0"), folder, "t")
    assert tables.read_table(spark, folder, "t").count() == 2
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith(".last")] == []
