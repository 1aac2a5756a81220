"""colscope: tabular profiling, correlation and pivot tables on Spark DataFrames."""

from colscope.operators.balance import class_balance
from colscope.operators.correlation import correlation_report
from colscope.operators.pivot import pivot_report, pivot_table
from colscope.operators.profile import profile
from colscope.operators.selection import chart_data, select_diverse
from colscope.sources.readers import read_table
from colscope.sources.validation import validate_source

__all__ = [
    "class_balance", "correlation_report", "pivot_report", "pivot_table", "profile",
    "chart_data", "select_diverse", "read_table", "validate_source",
]
