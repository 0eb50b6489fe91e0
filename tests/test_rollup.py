"""The host x vulnerability table: rows are multiplied by the last join, whose result is not shuffled."""

import pytest

from cpelink.operators import rollup as RU
from cpelink.sources import files as S


def _tables(spark):
    hosts = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None), (None, "z")], "ResourceID long, Site_X string")
    inv = spark.createDataFrame(
        [(1, "t", "1", "p", True), (1, "t", "1", "p", True), (2, "t", "1", None, False), (2, "u", None, "p", True),
         (3, "u", "2", "p", None), (9, "t", "1", "p", True), (None, "t", "1", "p", True)],
        "ResourceID long, DisplayName0 string, Version0 string, Publisher0 string, arch_X boolean")
    match = spark.createDataFrame([(f"v{k}", "t", "1", f"c{k}") for k in range(3)] + [("v0", "u", "2", "c0"), ("v9", "u", "2", "none")],
                                  "vendor_X string, DisplayName0 string, Version0 string, t_cve_name string")
    worst = spark.createDataFrame([(f"c{k}", 5.0, "LOW", "LOCAL", "High") for k in range(3)],
                                  "cpe_prod string, cvss_score double, cvss_acc_cmpl_cat string, cvss_acc_vect_cat string, crit_X_cat string")
    return hosts, inv, match, worst


def _plain(hosts, inv, match, worst):
    """The same join in its plain order: products x inventory, then the hosts."""
    return hosts.join(inv.join(RU.vulnerable_products(match, worst), RU.PRODUCT_KEYS), "ResourceID")


def _above(plan: str, join: str) -> str:
    return plan[:plan.index(join)]


def test_rows_are_not_shuffled_once_multiplied(spark):
    tables = _tables(spark)
    want = _plain(*tables)
    for limit in (RU.LISTED_PRODUCTS, 0):       # few products, and more than are listed
        old, RU.LISTED_PRODUCTS = RU.LISTED_PRODUCTS, limit
        threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            got = RU.hosts_with_vulns(*tables)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert got.columns == want.columns
            assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
            join = "BroadcastHashJoin [DisplayName0" if limit else "SortMergeJoin [DisplayName0"
            assert "Exchange" not in _above(plan, join) and "ResourceID" in plan[plan.index(join) + len(join):]
        finally:
            RU.LISTED_PRODUCTS = old
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got.count() == 2 * 3 + 2 * 3 + 1


def _folded(spark):
    hosts = spark.createDataFrame([(1, "s1", "vip"), (2, "s2", None), (3, None, None)], "ResourceID long, Site_X string, VIP_X string")
    inv = spark.createDataFrame(
        [(1, "a", "1", "p", True), (1, "a", "1", "p", True), (2, "a", "1", "q", False), (2, "b", "2", "p", None), (3, "b", "2", "p", True),
         (3, "c", None, "p", True), (9, "a", "1", "p", True), (2, "none", "1", "p", True)],
        "ResourceID long, DisplayName0 string, Version0 string, Publisher0 string, arch_X boolean")
    match = spark.createDataFrame([(f"v{k}", n, v, f"c{k}{n}") for k in range(5) for n, v in (("a", "1"), ("c", None))]
                                  + [("v0", "b", "2", "c0b"), ("v0", "b", "2", "c0b"), ("v1", "b", "2", "no_cve")],
                                  "vendor_X string, DisplayName0 string, Version0 string, t_cve_name string")
    worst = spark.createDataFrame([(f"c{k}{n}", float(k), "High" if k < 3 else None) for k in range(5) for n in "abc"],
                                  "cpe_prod string, cvss_score double, crit_X_cat string")
    return hosts, inv, match, worst


@pytest.mark.parametrize("listed", [100_000, 0])
def test_folded_table_stands_for_the_whole(spark, monkeypatch, listed):
    from collections import Counter
    from cpelink.operators import reports as R
    monkeypatch.setattr(RU, "LISTED_PRODUCTS", listed)
    tables = _folded(spark)
    whole = RU.hosts_with_vulns(*tables)
    items, products = RU.folded_hosts_with_vulns(*tables)
    assert items.count() == 5 and whole.count() == 19           # an item is one row, whatever its products
    assert Counter(map(tuple, RU.unfold(items, products).select(whole.columns).collect())) == Counter(map(tuple, whole.collect()))
    found = {r.t_cve_name: r[RU.TIMES] for r in RU.fold_products(items, products).where("DisplayName0 = 'a'").collect()}
    assert found == {f"c{k}a": 3 for k in range(5)}
    exact = {tuple(r) for r in R.profile_distinct(whole).collect()}
    of_items = R.profile_distinct(items, times=RU.TIMES)
    of_products = R.profile_distinct(RU.fold_products(items, products).drop(*RU.PRODUCT_KEYS), times=RU.TIMES)
    assert {tuple(r) for r in of_items.union(of_products).collect()} == exact


@pytest.mark.parametrize("listed, most", [(100_000, 1_000), (0, 1_000), (100_000, 2)])
def test_nested_table_holds_every_row(spark, monkeypatch, tmp_path, listed, most):
    from collections import Counter
    monkeypatch.setattr(RU, "LISTED_PRODUCTS", listed)
    monkeypatch.setattr(RU, "LIST_PRODUCTS", most)
    for tables in (_tables(spark), _folded(spark)):
        whole = RU.hosts_with_vulns(*tables)
        nested = RU.nested_hosts_with_vulns(*tables)
        S.save_stage(nested, str(tmp_path), "nested")
        stored = S.load_stage(spark, str(tmp_path), "nested", nested.schema)
        got = RU.flatten(stored)
        assert got.columns == whole.columns and [f.dataType for f in got.schema] == [f.dataType for f in whole.schema]
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, whole.collect()))
        entries = [len(r[RU.NESTED]) for r in stored.collect()]
        assert sum(entries) == whole.count()                    # one entry for each row of the whole table
        if most == 1_000:
            assert len(entries) == 5                            # and one row for each installed item
        else:
            assert len(entries) > 5                             # a long list is dealt to several
    filled = RU.flatten(RU.nested_hosts_with_vulns(*_no_version(tables), fill_version_on_join=True))
    want = RU.hosts_with_vulns(*_no_version(tables), fill_version_on_join=True)
    assert Counter(map(tuple, filled.collect())) == Counter(map(tuple, want.collect())) and filled.count() == 24


@pytest.mark.parametrize("listed, most, hosts_in_list", [(100_000, 1_000, 50_000), (0, 1_000, 50_000), (100_000, 2, 1)])
@pytest.mark.parametrize("by", [["Site_X"], []])
def test_grouped_table_stands_for_every_row(spark, monkeypatch, tmp_path, listed, most, hosts_in_list, by):
    from collections import Counter
    monkeypatch.setattr(RU, "LISTED_PRODUCTS", listed)
    monkeypatch.setattr(RU, "LIST_PRODUCTS", most)
    monkeypatch.setattr(RU, "LIST_HOSTS", hosts_in_list)
    for hosts, *tables in (_tables(spark), _folded(spark)):
        whole = RU.hosts_with_vulns(hosts, *tables)
        grouped, names = RU.grouped_hosts_with_vulns(hosts, *tables, by)
        S.save_stage(grouped, str(tmp_path), "grouped")
        stored = S.load_stage(spark, str(tmp_path), "grouped", grouped.schema)
        got = RU.flatten(stored).select(names)
        assert names == whole.columns and [f.dataType for f in got.schema] == [f.dataType for f in whole.schema]
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, whole.collect()))
        entries = [(len(r[RU.INSTALLED]), len(r[RU.NESTED])) for r in stored.collect()]
        assert sum(i * p for i, p in entries) == whole.count()
        if most == 1_000:
            assert sum(i for i, _ in entries) == 5              # an entry for each installed item
    none, names = RU.grouped_hosts_with_vulns(hosts.limit(0), *tables, by)
    assert RU.flatten(none).select(names).count() == 0


def _no_version(tables):
    """The tables with a match of an item without a version, as it stands in ``products_of``."""
    hosts, inv, match, worst = tables
    return hosts, inv, match.na.fill("-", ["Version0"]), worst


def test_cube_of_counts_equals_cube_of_rows(spark):
    from collections import Counter
    from pyspark.sql import functions as F
    from cpelink.operators import reports as R
    hosts, *tables = _folded(spark)
    hosts = hosts.withColumns({"HostFn_X": F.lit("server"), "Region_X": F.when(F.col("ResourceID") == 1, F.lit("Region_A"))})
    items, products = RU.folded_hosts_with_vulns(hosts, *tables)
    counted = RU.count_folded(items, products, ["Site_X", "HostFn_X", "VIP_X", "Region_X"])
    assert counted.count() == 14                                # the two equal items of host 1 are one count
    plain = R.count_cube(RU.hosts_with_vulns(hosts, *tables), "Region_A")
    assert Counter(map(tuple, R.count_cube(counted, "Region_A", RU.TIMES).collect())) == Counter(map(tuple, plain.collect()))
