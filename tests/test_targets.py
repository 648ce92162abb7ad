"""Target lists and spreadsheet files as data sources, there and back."""

import csv

import pytest
from pyspark.sql import functions as F

from dossier.operators import fill
from dossier.sources import targets

LIST = """# targets
- name: lost
  url: https://x
faculty:
  - university_name: "Zorbia Tech"   
    department: Chemistry
    url: https://z/faculty
    enabled: true
    - not a key
  # a comment
  - university_name: Quuxland
    url: 'https://q'
    enabled: no
    disabled_reason: 403: blocked
  - department: nobody
    url: https://n
news:
  - name: News
    url: https://news
    enabled: true
  - name: no address
grants:
  - name: G
    url: https://g
"""


def test_target_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(LIST)
    (tmp_path / "b.yml").write_text("faculty:\r\n- name: B\r\n  url: u\r\n  enabled: true\r\n")
    (tmp_path / "c.txt").write_text("faculty:\n- name: C\n  url: u\n")
    (tmp_path / "empty.yaml").write_text("")
    targets.register(spark)
    rows = spark.read.format("target_files").load(str(tmp_path))
    got = sorted(((r.file, r.line, r.section, r.name, r.department, r.url, r.enabled, r.note, r.problem) for r in rows.collect()), key=str)
    assert got == sorted([
        ("a.yaml", 2, None, "lost", None, "https://x", False, None, "in no section"), ("a.yaml", 5, "faculty", "Zorbia Tech", "Chemistry", "https://z/faculty", True, None, None), ("a.yaml", 11, "faculty", "Quuxland", None, "https://q", False, "403: blocked", None),
        ("a.yaml", 15, "faculty", None, "nobody", "https://n", False, None, "no name"), ("a.yaml", 18, "news", "News", None, "https://news", True, None, None), ("a.yaml", 21, "news", "no address", None, None, False, None, "no address"),
        ("a.yaml", 23, "grants", "G", None, "https://g", False, None, None), ("b.yml", 2, "faculty", "B", None, "u", True, None, None),
    ], key=str)
    assert rows.rdd.getNumPartitions() == 3
    assert sorted(r.name for r in targets.usable(rows, "faculty").collect()) == ["B", "Quuxland", "Zorbia Tech"] and sorted(r.name for r in targets.enabled_targets(rows).collect()) == ["B", "Zorbia Tech"]
    assert spark.read.format("target_files").load(str(tmp_path / "b.yml")).count() == 1
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("target_files").load(str(tmp_path / "nowhere")).count()


def test_csv_files(spark, tmp_path):
    targets.register(spark)
    rows = [(k, f'say "{k}", twice' if k % 3 else "plain", None if k % 2 else "two\r\nlines") for k in range(57)]
    df = spark.createDataFrame(rows, "id int, text string, more string").repartition(3)
    out = str(tmp_path / "out")
    df.write.format("csv_files").option("rows", 10).mode("overwrite").save(out)

    def read():
        back = []
        for f in (tmp_path / "out").iterdir():
            raw = f.read_bytes()
            assert raw.startswith(b"\xef\xbb\xbfid,text,more\r\n") and raw.endswith(b"\r\n")
            own = list(csv.reader(raw.decode("utf-8-sig").splitlines(keepends=True)))[1:]
            assert 1 <= len(own) <= 10
            back += own
        return sorted(back, key=lambda r: int(r[0]))

    assert read() == [[str(a), b, c or ""] for a, b, c in rows]
    df.where("id < 5").write.format("csv_files").option("rows", 10).mode("append").save(out)
    assert len(read()) == 62
    broken = df.withColumn("id", F.when(F.col("id") == 40, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("csv_files").option("rows", 10).mode("overwrite").save(out)
    assert len(read()) == 62
    df.limit(4).write.format("csv_files").option("rows", 10).mode("overwrite").save(out)
    assert len(read()) == 4


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    folder = str(tmp_path / "store")
    one, two = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="no version"):
        fill.committed(spark, folder, "leads")
    assert fill.commit(spark, folder, leads=one, members=one) == 1
    bad = two.withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        fill.commit(spark, folder, leads=two, members=bad)
    assert fill.committed(spark, folder, "leads").first().v == "a" and fill.committed(spark, folder, "members").first().v == "a"
    for _ in range(3):
        fill.commit(spark, folder, leads=two, members=two)
    assert fill.committed(spark, folder, "leads").first().v == "b" and fill.versions(spark, folder) == [3, 4]
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if p.name.startswith("version")) == ["version=3", "version=4"]


def test_fill_rules(spark):
    lead = "lead_id int, orcid string, institution string, profile_url string, email string, title string, department string, phone string, website string"
    leads = spark.createDataFrame([(1, "o1", "Zorbia Tech", "p1", None, "", None, None, None), (2, "o2", "Zorbia Tech", None, "e", "Dean", "D", "1", "w"), (3, "o1", "Zorbia Tech", None, None, None, None, None, None), (4, None, "Zorbia Tech", None, None, None, None, None, None)], lead)
    members = spark.createDataFrame([(1, "promoted", 1, None, None, None, None, None, None), (2, "promoted", 2, None, "m", None, None, None, None), (3, "eligible", 3, None, None, None, None, None, None), (4, "promoted", 4, None, None, None, None, None, None), (5, "promoted", None, None, None, None, None, None, None), (6, "promoted", 1, "own", None, None, None, None, None)], "member_id int, status string, lead_id int, profile_url string, email string, title string, department string, phone string, website string")
    persons = spark.createDataFrame([("o1", ["a@x", "b@x"], [("x", "https://orcid.org/1"), ("h", "https://ann")])], "orcid string, emails array<string>, urls array<struct<name:string,url:string>>")
    jobs = spark.createDataFrame([("o1", 1, "Elsewhere", "Head", "No", True), ("o1", 2, "Zorbia Tech Campus", "PhD student", "Chem", True), ("o1", 3, "Zorbia Tech", "Professor", "Bio", True), ("o1", 0, "Zorbia Tech", "Dean", "Old", False)], "orcid string, seq int, organization string, role string, department string, current boolean")
    web = spark.createDataFrame([(1, "w@x", "Professor", None, "+1", None), (4, " ", "Head", None, None, None)], "lead_id int, email string, title string, department string, phone string, website string")
    after, roster = fill.fill_missing(leads, members, persons, jobs, web)
    got = {r.lead_id: r for r in after.collect()}
    assert (got[1].email, got[1].title, got[1].department, got[1].phone, got[1].website, got[1].filled, got[1].filled_from_web) == ("a@x", "Professor", "Chem", "+1", "https://ann", ["email", "department", "website"], ["title", "phone"])
    assert got[2].filled == [] and got[3].email is None and got[3].filled == [] and (got[4].title, got[4].filled_from_web) == ("Head", ["title"])
    m = {r.member_id: r for r in roster.collect()}
    assert (m[1].email, m[1].profile_url, m[2].email, m[2].title, m[3].email, m[4].title, m[5].email, m[6].profile_url, m[6].phone) == ("a@x", "p1", "m", "Dean", None, "Head", None, "own", "+1")
    assert tuple(fill.fill_summary(after, roster).first()) == (4, 3, 2, 3, 1)
