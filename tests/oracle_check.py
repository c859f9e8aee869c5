"""Run registered queries beside their DuckDB statements: ``python tests/oracle_check.py DIR [name ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(frame):
    """Rows with columns in name order, as a sorted list of text tuples."""
    import math

    names = sorted(frame.columns)

    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return "∅"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, float):
            return repr(v) if v != int(v) else str(int(v))
        if type(v).__name__ == "float64":
            return repr(float(v)) if float(v) != int(v) else str(int(v))
        return str(v)

    return names, sorted(tuple(text(v) for v in row) for row in frame[names].itertuples(index=False))


def compare(spark, con, name, query, sql, sf_dir):
    begin = time.time()
    got_names, got = canonical(query(spark, sf_dir).toPandas())
    spent = time.time() - begin
    if sql is None:
        return True, f"rows-only {len(got)} rows {spent:.1f}s {got_names}"
    want_names, want = canonical(con.sql(sql).df())
    if got_names != want_names:
        return False, f"columns {got_names} vs {want_names}"
    if got != want:
        extra = sorted(set(got) - set(want))[:2]
        lost = sorted(set(want) - set(got))[:2]
        return False, f"{len(got)} vs {len(want)} rows; {got_names}\n  spark {extra}\n  duck  {lost}"
    return True, f"ok {len(got)} rows {spent:.1f}s"


def main():
    import duckdb

    import __spark_entry__ as entry
    from evidmill.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                              "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    print(len(queries), "queries", len(oracles), "oracles", sorted(set(oracles) - set(queries)))
    bad = []
    for name, query in queries.items():
        if wanted and not any(name == w or name.startswith(w + "_") for w in wanted):
            continue
        try:
            good, note = compare(spark, con, name, query, oracles.get(name), sf_dir)
        except Exception as exc:  # report and go on with the next query
            good, note = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        if not good:
            bad.append(name)
        print("PASS" if good else "FAIL", name, note, flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
