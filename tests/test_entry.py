import __spark_entry__ as driver


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_registry():
    assert set(driver.oracle_sql()) <= set(driver.queries()) and len(driver.queries()) > 150
