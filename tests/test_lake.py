"""Queries against their SQL on the smallest tables, and the batch run with its failures."""

import csv

import duckdb
import pytest

import __spark_entry__ as entry
from tarnlake import run as batch
from tarnlake.operators import changes, history
from tarnlake.plans import oracle, queries
from tarnlake.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order]) for r in found)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    c = db.execute(oracle.SQL[name])
    assert rows(df.columns, map(tuple, df.collect())) == rows([x[0] for x in c.description], c.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_changes_keep_null_values_and_previous_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    new = spark.createDataFrame([(1, None), (2, "b"), (4, "d")], "id int, v string")
    found = {r.id: (r.v, r.change_type) for r in changes.changes(new, old, ["id"]).collect()}
    assert found == {1: (None, "UPDATED"), 2: ("b", "UNCHANGED"), 3: ("c", "DELETED"), 4: ("d", "INSERTED")}


def test_as_of_at_the_edges_of_an_interval(spark):
    h = spark.sql("select * from values ('k', date'2020-01-01', date'2020-01-31', false, 1), ('k', date'2020-02-10', cast(null as date), true, 2) as t(k, effective_from, effective_to, is_current, record_version)")
    f = spark.sql("select * from values (1, 'k', date'2020-01-31'), (2, 'k', date'2020-02-10'), (3, 'k', date'2020-02-01'), (4, 'k', date'2019-12-31') as t(id, k, day)")
    found = {r.id: r.sk for r in history.as_of(f, h, "k", "day", "sk").collect()}
    assert found[1] and found[2] and found[1] != found[2] and found[3] is None and found[4] is None


def day_one():
    return {
        "customers": [["C1", "ann", "lee", "A@x.com", "1", "oslo", "s", "no", "2022-01-01", "Gold"], ["C2", "bo", "ek", "bad", "2", "rome", "s", "it", "2022-01-01", "Silver"], ["C3", "cy", "o", "c@x.com", "3", "kiev", "s", "ua", "2022-01-01", "Gold"]],
        "products": [["P1", "pen", "office", "b", "2.5", "5"], ["P2", "cup", "home", "b", "4", "7"]],
        "orders": [["O1", "C1", "2026-01-02 10:00:00", "Delivered", "x", "y"], ["O2", "C3", "2026-01-05 10:00:00.000001", "Pending", "x", "y"], ["O3", "C9", "2026-01-05 10:00:00", "Pending", "x", "y"]],
        "order_items": [["I1", "O1", "P1", "2", "2.5", "10"], ["I2", "O2", "P2", "1", "4", "0"], ["I3", "O3", "P2", "1", "4", "0"]],
        "payments": [["Y1", "O1", "UPI", "Success", "4.5", "2026-01-02 10:05:00"], ["Y2", "O2", "Wallet", "Refunded", "4", "2026-01-05 10:05:00"], ["Y3", "O3", "Wallet", "Success", "4", "2026-01-05 10:05:00"]],
    }


def source(folder, tables, **header):
    folder.mkdir()
    for name, body in tables.items():
        with open(folder / f"{name}.csv", "w", newline="") as f:
            csv.writer(f).writerows([header.get(name) or [c.split()[0] for c in batch.SCHEMAS[name].split(", ")], *body])
    return str(folder)


def test_two_batches_then_failures(spark, tmp_path):
    root, one = str(tmp_path / "lake"), day_one()
    log = batch.run(spark, root, source(tmp_path / "d1", one), "2026-01-10")
    assert log["status"] == "SUCCESS", log
    read = lambda layer, name, d: files.read_layer(spark, root, layer, d, name)
    assert {r.order_item_id for r in read("quarantine", "order_items", "2026-01-10").collect()} == {"I3"}
    assert read("marts", "executive_kpis", "2026-01-10").first().total_orders == 2
    two = day_one()
    two["customers"][0][-1] = "Platinum"
    two["orders"].append(["O4", "C1", "2026-01-11 09:00:00", "Shipped", "x", "y"])
    two["order_items"].append(["I4", "O4", "P1", "1", "2.5", "0"])
    assert batch.run(spark, root, source(tmp_path / "d2", two), "2026-01-11")["status"] == "SUCCESS"
    versions = [(r.record_version, str(r.effective_to), r.is_current) for r in read("history", "customers", "2026-01-11").where("customer_id = 'C1'").orderBy("record_version").collect()]
    assert versions == [(1, "2026-01-10", False), (2, "None", True)]
    segments = {r.order_id: r.record_version for r in read("gold", "fact_sales", "2026-01-11").join(read("gold", "dim_customer", "2026-01-11").select("customer_sk", "record_version"), "customer_sk").collect()}
    assert segments == {"O1": 1, "O2": 1, "O4": 2}

    def fails(name, change, **header):
        bad = day_one()
        change(bad)
        found = batch.run(spark, root, source(tmp_path / name, bad, **header), "2026-01-12")
        assert found["status"] == "FAILED" and found["stages"][-1]["stage"] == "bronze"

    fails("text", lambda t: t["products"][0].__setitem__(4, "N/A"))
    fails("twice", lambda t: t["orders"].append(t["orders"][0]))
    fails("extra", lambda t: [r.insert(4, "EUR") for r in t["products"]], products="product_id product_name category brand currency price stock_quantity".split())
    fails("ragged", lambda t: t["payments"].__setitem__(-1, ["Y3", "O3"]))
    assert files.previous_batch(spark, root, "2026-01-13") == "2026-01-11"  # failed batches don't count
    assert batch.run(spark, root, str(tmp_path / "d2"), "2026-01-14", "gold")["status"] == "FAILED"  # its layers aren't there


def test_manifest(tmp_path):
    (tmp_path / "a.csv").write_text("x")
    m = files.scan_files(str(tmp_path), "*.csv", {})
    assert m["a.csv"]["change"] == "NEW"
    files.advance(m, "a.csv", "PROCESSING")
    assert files.scan_files(str(tmp_path), "*.csv", m)["a.csv"]["state"] == "PENDING"
    files.advance(m, "a.csv", "PROCESSED")
    assert files.scan_files(str(tmp_path), "*.csv", m)["a.csv"]["state"] == "PROCESSED"
    with pytest.raises(ValueError):
        files.advance(m, "a.csv", "FAILED")
    files.save_manifest(m, str(tmp_path / "m.json"))


def test_no_surrogate_keys_are_stored(spark, monkeypatch):
    kept, real = [], queries.stored
    monkeypatch.setattr(queries, "stored", lambda df, *how: kept.append(df.columns) or real(df, *how))
    star_ = queries.build(spark, "/root/testdata/sf0.001", keep=True)
    assert kept and not [c for columns in kept for c in columns if c.endswith("_sk")]
    plain_ = queries.build(spark, "/root/testdata/sf0.001")
    for name in ("fact_sales", "fact_payment"):
        keys = [c for c in ("sales_sk", "payment_sk", "order_sk", "product_sk") if c in star_[name].columns]
        assert sorted(map(tuple, star_[name].select(keys).collect())) == sorted(map(tuple, plain_[name].select(keys).collect()))
