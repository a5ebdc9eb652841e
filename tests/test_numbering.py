"""Numbers of cases that come from the order of files and lines."""

import json

import pytest

from answergauge.sources.cases import read_cases


def write(folder, files):
    for name, lines in files.items():
        (folder / name).write_text("".join(lines), encoding="utf-8")


def case(i):
    return json.dumps({"prompt": f"p{i} é", "expect_keywords": ["a", str(i)]}, ensure_ascii=False)


@pytest.mark.parametrize("most_bytes", ["40", "333", "5000", "128m"])
def test_numbers_do_not_depend_on_splits(spark, tmp_path, most_bytes):
    number, files, want = 0, {}, []
    for name, n in (("b.json", 70), ("a.json", 1), ("c 1.json", 0), ("d.json", 200), ("é.json", 13)):
        files[name] = [case(f"{name}-{i}") + ("\n\n \n" if i % 7 == 3 else "\r\n" if i % 7 == 4 else "\n") for i in range(n)]
    files["d.json"][-1] = files["d.json"][-1].rstrip()  # no line break at the end
    for name in sorted(files):
        for line in files[name]:
            want.append((number, json.loads(line)["prompt"]))
            number += 1
    write(tmp_path, files)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", most_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        cases = read_cases(spark, str(tmp_path), "json", env={}, numbered=True)
        plan = cases._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["case_pos"], r["prompt"]) for r in cases.collect())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == want and "Window" not in plan and "Sort " not in plan.replace("SortMerge", "")


def test_missing_fields_and_bad_lines(spark, tmp_path):
    write(tmp_path, {"a.json": ['{"case_id": "x", "case_pos": 99}\n', "{}\n"]})
    rows = sorted(read_cases(spark, str(tmp_path), "json", env={}, numbered=True).collect(), key=lambda r: r["case_pos"])
    assert [(r["case_pos"], r["case_id"], r["expect_keywords"]) for r in rows] == [(0, "x", None), (1, None, None)]
    write(tmp_path, {"b.json": ['{"case_id": \n']})
    with pytest.raises(Exception):
        read_cases(spark, str(tmp_path), "json", env={}, numbered=True).collect()


def test_no_folder_and_no_lines(spark, tmp_path):
    assert read_cases(spark, f"{tmp_path}/none", "json", numbered=True).count() == 0
    write(tmp_path, {"a.json": ["\n", " \n"]})
    assert read_cases(spark, str(tmp_path), "json", numbered=True).count() == 0
    with pytest.raises(ValueError):
        read_cases(spark, str(tmp_path), "parquet", numbered=True)
