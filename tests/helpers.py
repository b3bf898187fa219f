from tablediff.plans.compare import compare
from tablediff.spec import ComparisonSpec, Location


def run_pair(spark, cand, base, keys=("id",), rng=None, sample_size=100, **spec_kw):
    spec_kw.setdefault("full_refresh", spec_kw.get("range_column") is None)
    spec = ComparisonSpec(
        name="t",
        candidate=Location.of(cand),
        baseline=Location.of(base),
        kind="frame",
        key_columns=() if spec_kw.get("keyless") else keys,
        **spec_kw,
    )
    return compare(spark, spec, rng=rng, sample_size=sample_size)


def disagreeing(result):
    out = []
    for c in result.checks or []:
        if not c["agrees"]:
            out.append(c["check_name"] + (":" + c["column_name"] if c["column_name"] else ""))
    return out


def check(result, name, column=None):
    for c in result.checks:
        if c["check_name"] == name and (column is None or c["column_name"] == column):
            return c
    raise KeyError((name, column))
