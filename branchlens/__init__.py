"""branchlens: retail POS analytics on Spark DataFrames.

Report cleaning, margins, product and branch profiles, channel shares,
rankings, monthly seasonality and forecasts, grouped clustering with success
tiers, ridge rollout models, scenario tables, NMF of branch product mixes and
the dashboard queries, each as a DataFrame -> DataFrame function.
"""

__version__ = "0.1.0"
