import __spark_entry__ as e

DATA = "/root/testdata/sf0.001"


def test_every_oracle_statement_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    assert e.entry(spark).count() == 8


def test_some_queries_equal_their_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    flat = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    for name in ("label_three_class", "metric_auc", "blend_best", "select_anova_top", "window_mean_std"):
        df = e.queries()[name](spark, DATA)
        cols = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({e.oracle_sql()[name]})").fetchall()
        assert flat(df.select(*cols).collect()) == flat(want), name
