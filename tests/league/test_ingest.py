from leaguelens.operators import identity as I
from leaguelens.operators import validation as V
from leaguelens.sources import round_files as R


def test_files_with_quotes_and_blank_lines(spark, tmp_path):
    (tmp_path / "2001_round_2.csv").write_text('name1,hall1,score1,name2,hall2,score2\n"Doe, Jane",1, 10.5 ,"O""Hara",2,3\n\nA,1,TIMEOUT,B,2,\nWALKOVER,,,C,2,\n')
    (tmp_path / "Round_3.csv").write_text("name1,hall1,score1,name2,hall2,score2\nA,1,x,B,2,1\nWALKOVER,1,,WALKOVER,2,\nA,1,-1,B,2,1\n")
    rows = R.read_rounds(spark, str(tmp_path), 1999)
    good, bad = V.split_rows(rows, "_corrupt")
    got = sorted((r.year, r.round_order, r.row_no, r.name1, r.score1) for r in good.collect())
    assert got == [(2001, 2, 1, "Doe, Jane", "10.5"), (2001, 2, 2, "A", "TIMEOUT"), (2001, 2, 3, "WALKOVER", "")]
    assert sorted((r.year, r.row_no, r.rule) for r in bad.collect()) == [(1999, 1, "VAL-5"), (1999, 2, "VAL-3"), (1999, 3, "VAL-5")]
    assert {r.ok for r in V.headers(spark, str(tmp_path)).collect()} == {True}


def test_fuzzy_names(spark):
    known = spark.createDataFrame([("1", "Jane Doe", 2003), ("2", "Jan Doe", 2001), ("3", "Ng", 2003), ("4", "Doe, Jane Ann", 2002), ("5", "Peter Pan", 2002)], "player_id string, name string, last_seen_year int")
    asked = spark.createDataFrame([("Jane Do",), ("jane  doe",), ("Nightingale",), ("Petre Pan",), ("Zoe",)], "name string")
    got = {(r.asked, r.player_id): r.kind for r in I.fuzzy_pairs(asked, known).collect()}
    assert got[("Jane Do", "1")] == "partial" and got[("Jane Do", "2")] == "spelling"
    assert got[("Petre Pan", "5")] == "spelling" and ("Nightingale", "3") not in got and not any(a == "Zoe" for a, _ in got)
    best = {r.asked: r.player_id for r in I.best_fuzzy(I.fuzzy_pairs(asked, known)).collect()}
    assert best["Jane Do"] == "1" and best["Petre Pan"] == "5"


def test_registry_without_the_other_package():
    from leaguelens.plans import registry

    assert len(registry.QUERIES) > 120 and set(registry.ORACLES) <= set(registry.QUERIES)
    assert not any("llm" in str(getattr(f, "__module__", "")) for f in registry.QUERIES.values())
