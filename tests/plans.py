"""What tests ask of physical plans."""


def plan_of(df) -> str:
    """The physical plan before execution."""
    return df._jdf.queryExecution().executedPlan().toString()
