"""Checks that would pass on empty or one-sided inputs must not meet any:
the registered queries' inputs have both outcomes."""

import __spark_entry__ as entry
from conftest import SF01


def _rows(spark, name):
    return entry.queries()[name](spark, SF01).collect()


def test_cleaning_drops_rows_at_every_step(spark):
    r = _rows(spark, "C6_cleaning_report")[0]
    assert min(r.dropped_dates, r.dropped_other, r.dropped_numeric) > 0
    assert r.kept_rows + r.dropped_dates + r.dropped_other + r.dropped_numeric == r.initial_rows


def test_labels_have_both_values_in_every_cell(spark):
    cells = _rows(spark, "A14_rule_quality")
    assert all(0 < c.valid_rules < c.total_rules for c in cells if c.total_rules > 1)
    assert any(0 < c.rules_before_first_zero < c.valid_rules for c in cells)
    assert {r.precision < 1 for r in _rows(spark, "W2_precision_at_k")} == {True, False}


def test_purge_keeps_some_pairs_and_drops_others(spark):
    from ledgerlens import schema as S
    from ledgerlens.operators import similarity as SIM
    from ledgerlens.plans import queries as Q
    found = SIM.cosine_pairs(*Q._detail_sides(spark, SF01), S.APP_SIMILARITY_THRESHOLD).count()
    assert 0 < len(_rows(spark, "T6_purge_identical")) < found
    parts = spark.read.parquet(f"{SF01}/part.parquet").count()
    assert 0 < sum(r.table_name == "barang" for r in _rows(spark, "T6_purged_tables")) < parts


def test_some_bundles_are_replaced_and_renumbered(spark):
    new = _rows(spark, "M13_replace_first")
    assert 0 < len(new) < len(_rows(spark, "M4_bundle_all"))
    assert sorted(r.id_bundling for r in new) == list(range(1, len(new) + 1))


def test_orphans_are_found_where_products_are_missing(spark):
    bad, good = _rows(spark, "M16_inconsistency")[0], _rows(spark, "M16_consistency")[0]
    assert bad.orphans > _rows(spark, "J7_orphan_bundles")[0].orphans > 0 and not bad.consistent
    assert good.orphans == 0 and good.consistent
    assert _rows(spark, "A13_bundle_report_deadstock")


def test_every_class_and_unsold_names_occur(spark):
    classes = {r["class"]: r.n_products for r in _rows(spark, "G10_class_counts")}
    assert {"All Products", "Sold Together", "Sold Alone", "Not Sold"} <= {k for k, v in classes.items() if v}
    kinds = [r.is_deadstock for r in _rows(spark, "G11_product_dimension")]
    assert 0 < sum(kinds) < len(kinds)
    assert _rows(spark, "M1_rules_low_confidence")
