"""Sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from keepwell.functions import values as V
from keepwell.sources import contracts, tables


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_is_typed_by_its_contract(spark, tmp_path):
    path = write(tmp_path / "shop.csv", "customerID,logins_per_week,cart_abandonment_rate,extra col\n"
                 "a,3,0.5,x y\nb,oops,0.1,z\n")
    df = tables.read_source(spark, path, contracts.SHOP)
    rows = {r.customerID: r for r in df.collect()}
    assert rows["a"]["extra col"] == "x y" and rows["a"].logins_per_week == 3 and rows["a"]._corrupt_record is None
    assert rows["b"].logins_per_week is None and rows["b"]._corrupt_record.startswith("b,oops")


def test_missing_file_and_missing_columns_raise(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_source(spark, str(tmp_path / "none.csv"), contracts.SHOP)
    path = write(tmp_path / "bank.csv", "CustomerId,Balance\n1,2\n")
    with pytest.raises(contracts.ContractError, match="CreditScore"):
        tables.read_source(spark, path, contracts.BANK)


def test_file_order_is_kept(spark, tmp_path):
    path = write(tmp_path / "s.csv", "customerID\n" + "\n".join(f"c{i:03d}" for i in range(50)) + "\n")
    df = tables.read_source(spark, path, contracts.SHOP, order="place")
    assert [r.customerID for r in df.orderBy("place").collect()] == [f"c{i:03d}" for i in range(50)]


def test_contract_document_round_trip(tmp_path):
    document = {"title": "shop", "required": ["customerID"], "properties": {
        "customerID": {"type": "string"}, "n": {"type": "integer", "enum": [0, 1]}}}
    path = write(tmp_path / "c.json", json.dumps(document))
    assert contracts.load_contract(path) == contracts.load_contract(json.dumps(document))
    assert contracts.load_contract(path).columns[1].allowed == (0, 1)


def test_shipped_contracts():
    assert [len(c.columns) for c in (contracts.CUSTOMERS, contracts.BANK, contracts.TICKETS, contracts.SHOP)] == [21, 14, 18, 7]
    assert len(contracts.CUSTOMERS.required) == 21 and "customerID" in contracts.TICKETS.required


def test_feature_contract():
    names = V.model_columns()
    assert len(names) == 45 == len(set(names))
    assert names[0] == "tenure" and names[6] == "PaymentMethod_Bank transfer (automatic)" and names[-1] == "competitor_promotion_flag"


def test_groups_by_date_and_snapshot(spark, tmp_path):
    root = str(tmp_path / "store")
    groups = {"one": ["customerID", "a"], "two": ["customerID", "a", "b"]}
    df = spark.createDataFrame([("x", 1, 2), ("y", 3, 4)], "customerID string, a int, b int")
    tables.write_groups(df, root, "2024-03-01", groups)
    tables.write_groups(df.limit(1), root, "2024-04-01", groups)
    tables.write_groups(df.limit(1), root, "2024-04-01", groups)
    march = tables.read_snapshot(spark, root, "2024-03-01", ["one", "two"])
    assert march.columns == ["customerID", "a", "b"] and march.count() == 2
    assert tables.read_snapshot(spark, root, "2024-04-01", ["one", "two"]).count() == 1
    with pytest.raises(FileNotFoundError, match="no committed snapshot 2024-05-01"):
        tables.read_snapshot(spark, root, "2024-05-01", ["one", "two"])
    partial = tables.join_groups([df, df.limit(1).select("customerID", F.lit(1).alias("c"))])
    assert partial.count() == 1


def test_outcome_log_appends_with_ids_and_times(spark, tmp_path):
    path = str(tmp_path / "log")
    sent = spark.createDataFrame([("a", "offer", 1), ("b", "offer", 0)], "customer_id string, intervention_type string, outcome int")
    tables.append_outcomes(sent, path)
    tables.append_outcomes(sent, path)
    rows = tables.read_outcomes(spark, path).collect()
    assert len({r.id for r in rows}) == 4 and all(r.timestamp is not None for r in rows)


def test_cache_computes_each_text_once_and_replaces_by_version(spark, tmp_path):
    path = str(tmp_path / "cache")
    texts = spark.createDataFrame([("please cancel",), (" please cancel\n",), ("hello",), (None,)], "body string")
    assert tables.update_text_cache(texts, "body", path, 1) == (2, 0)
    more = spark.createDataFrame([("hello",), ("my bill",)], "body string")
    assert tables.update_text_cache(more, "body", path, 2) == (1, 1)
    assert tables.read_text_cache(spark, path).count() == 3
    old = tables.read_text_cache(spark, path).where("urgency_level = 'critical'")
    tables.replace_in_cache(old.withColumn("urgency_level", F.lit("low")), path, 3)
    levels = {r.urgency_level for r in tables.read_text_cache(spark, path).collect()}
    assert levels == {"low"} and tables.read_text_cache(spark, path).count() == 3


def test_only_missing_texts_are_extracted_and_none_is_shuffled(spark, tmp_path, monkeypatch):
    path, plans = str(tmp_path / "cache"), []
    texts = spark.createDataFrame([(f"my bill {i % 40}", "x", "y") for i in range(200)], "body string, filter_word string, known string")
    assert tables.update_text_cache(texts.where("body < 'my bill 3'"), "body", path, 1) == (23, 0)
    real = tables.distinct_text_features

    def seen(rows, *args):
        assert rows.select("text").distinct().count() == 17  # the others are known
        out = real(rows, *args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(tables, "distinct_text_features", seen)
    assert tables.update_text_cache(texts, "body", path, 2) == (17, 23)
    assert tables.read_text_cache(spark, path).count() == 40
    exchanged = [line for line in plans[0].split("\n") if "Exchange hashpartitioning" in line]
    assert exchanged and not any("text#" in line for line in exchanged)


def test_results_as_csv_and_json(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5, ["x", "y"])], "customerID string, churn_score double, top_drivers array<string>")
    tables.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert (back.customerID, back.top_drivers) == ("a", "x, y")
    tables.append_json(tables.manifest(rows, "2024-03-01", {"customers": "c.csv"}), str(tmp_path / "manifest"))
    tables.append_json(tables.manifest(rows, "2024-04-01", {"customers": "c.csv"}), str(tmp_path / "manifest"))
    found = spark.read.json(str(tmp_path / "manifest")).orderBy("snapshot_date").collect()
    assert [r.row_count for r in found] == [1, 1] and json.loads(found[0].source_files) == {"customers": "c.csv"}


def test_playbook_files_are_read_whole(spark, tmp_path):
    write(tmp_path / "a.txt", "one\ntwo")
    assert tables.read_sections(spark, str(tmp_path / "a.txt")).first().text == "one\ntwo"
