"""Rows the operators' tests share."""

#: Extra columns carry names the operators use inside.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, digest string, "
          "size long, key string, fp string, node string, label string, keep_id string")
TABLES = "/root/testdata/sf0.001"


def documents(spark, rows):
    """Documents from (doc_id, text[, lang[, source]])."""
    full = [(*r, *(None,) * (4 - len(r)), None, "x", 1, "x", "x", "x", "x", "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
