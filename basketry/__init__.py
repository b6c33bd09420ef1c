"""basketry: retail analytics jobs expressed as Spark DataFrame plans.

Every public function takes DataFrames (or a session and a data folder) and
returns a DataFrame. Nothing is collected to the driver inside an operator;
Catalyst plans the joins, aggregates and windows.
"""

__version__ = "0.1.0"
