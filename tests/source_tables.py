"""Source tables for the tests of the security library."""


def source_df(spark, files, repo="r"):
    """files: {path: content} -> (repo, path, language, bytes, content) via discovery."""
    from tidewatch.plans.scan import discover
    rows = [(repo, p, c, len(c.encode())) for p, c in files.items()]
    df = spark.createDataFrame(rows, "repo string, path string, content string, bytes long")
    return discover(df)
