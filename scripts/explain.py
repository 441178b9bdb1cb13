"""Print the physical plan of registered queries (formatted) plus a summary line:
exchanges, windows, sorts, pushed filters and read schemas of the scans.

Usage: python scripts/explain.py [sf_dir] name [name ...]
"""
import re
import sys

sys.path.insert(0, ".")
from barlake.plans.catalog import queries  # noqa: E402
from barlake.session import local_session  # noqa: E402


def summary(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    ex = len(re.findall(r"Exchange (?:hash|range|Single|Round)", plan))
    win = plan.count("Window [")
    sorts = len(re.findall(r"\bSort \[", plan))
    pushed = sorted(set(re.findall(r"PushedFilters: (\[[^\]]*\])", plan)))
    schemas = sorted(set(re.findall(r"ReadSchema: (struct<\S*)", plan)))
    return f"exchanges={ex} windows={win} sorts={sorts} pushed={pushed} read={schemas}"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 and "/" in sys.argv[1] else "/root/testdata/sf0.01"
    names = [a for a in sys.argv[1:] if "/" not in a]
    spark = local_session(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # static plan: what Catalyst chose
    for name in names:
        df = queries()[name](spark, sf)
        print(f"== {name}: {summary(df)}")
        if "-v" in sys.argv:
            df.explain("formatted")


if __name__ == "__main__":
    main()
