from conftest import DATA


def table_exists(sf):
    return (DATA / sf).exists()


def documents(spark, sf):
    read = lambda name: spark.read.parquet(f"{DATA}/{sf}/{name}.parquet")
    return read("documents"), read("labels")
