from collections import Counter

from sylvaspark.llm import lookalikes as L

SCHEMA = "offering_id long, instructor string, semester string, value string, n long"


def plain(spark, values, field="instructor"):
    rows = [(i, v if field == "instructor" else None, v if field == "semester" else None, "x", 1) for i, v in enumerate(values)]
    _, forms = L.look_alikes(spark, spark.createDataFrame(rows, SCHEMA), "offering_id", ["instructor", "semester"], ["semester"])
    return {r["value"]: r["plain"] for r in forms.collect()}


def test_names(spark):
    got = plain(spark, ["Peter Oxcroft"] * 30 + ["Реter Охсroft", "Ｐｅｔｅｒ Oxcroft", " Pe​ter Oxcroft ", "Ася Перосина", "Acя Перосинa", "Élodie", "Élodie", "⻢若溪", "马若溪、林见鹿", "한소율", "한소율", "A‐B", "Yıldar"] + ["Nguyễn"] * 30 + ["Nɡuyễn", "", "  ", None])
    assert got["Реter Охсroft"] == got["Ｐｅｔｅｒ Oxcroft"] == got[" Pe​ter Oxcroft "] == "Peter Oxcroft"
    assert got["Acя Перосинa"] == "Ася Перосина" == got["Ася Перосина"]
    assert got["Élodie"] == "Élodie" and got["⻢若溪"] == "马若溪" and got["한소율"] == "한소율"
    assert got["马若溪、林见鹿"] == "马若溪、林见鹿" and got["A‐B"] == "A-B" and got["Yıldar"] == "Yıldar" and got["Nɡuyễn"] == "Nguyễn"
    assert got[""] == "" and got["  "] == ""


def test_numbers(spark):
    got = plain(spark, ["З", "１－６", "l-8", "第ー学期", "第⼆学期", "秋季 Ⅰ", "1O", "2,4", "第3学期"], "semester")
    assert got == {"З": "3", "１－６": "1-6", "l-8": "1-8", "第ー学期": "第一学期", "第⼆学期": "第二学期", "秋季 Ⅰ": "秋季 1", "1O": "10", "2,4": "2,4", "第3学期": "第3学期"}


def test_empty_table_and_long_value(spark):
    assert plain(spark, []) == {}
    long = "ａ" * 50_000
    assert plain(spark, [long])[long] == "a" * 50_000


def test_classes_are_transitive():
    m = L.Model(Counter("aаαａ"))
    assert len({m.find(c) for c in "aаα"}) == 1 and m.find("ａ") == m.find("a")
