"""Reference dimensions: official state names and state centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The official names of states and union territories.
OFFICIAL_STATES = (
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa",
    "Gujarat", "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka", "Kerala",
    "Madhya Pradesh", "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland",
    "Odisha", "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura",
    "Uttar Pradesh", "Uttarakhand", "West Bengal", "Andaman & Nicobar", "Chandigarh",
    "Dadra & Nagar Haveli", "Daman & Diu", "Delhi", "Jammu & Kashmir", "Ladakh",
    "Lakshadweep", "Puducherry",
)

# Fixed values: (latitude, longitude) of each state's centre.
STATE_CENTROIDS = {
    "Andhra Pradesh": (15.91, 79.74),
    "Arunachal Pradesh": (28.21, 94.72),
    "Assam": (26.20, 92.93),
    "Bihar": (25.09, 85.31),
    "Chhattisgarh": (21.27, 81.86),
    "Goa": (15.29, 74.12),
    "Gujarat": (22.25, 71.19),
    "Haryana": (29.05, 76.08),
    "Himachal Pradesh": (31.10, 77.17),
    "Jharkhand": (23.61, 85.27),
    "Karnataka": (15.31, 75.71),
    "Kerala": (10.85, 76.27),
    "Madhya Pradesh": (22.97, 78.65),
    "Maharashtra": (19.75, 75.71),
    "Manipur": (24.66, 93.90),
    "Meghalaya": (25.46, 91.36),
    "Mizoram": (23.16, 92.93),
    "Nagaland": (26.15, 94.56),
    "Odisha": (20.95, 85.09),
    "Punjab": (31.14, 75.34),
    "Rajasthan": (27.02, 74.21),
    "Sikkim": (27.53, 88.51),
    "Tamil Nadu": (11.12, 78.65),
    "Telangana": (18.11, 79.01),
    "Tripura": (23.94, 91.98),
    "Uttar Pradesh": (26.84, 80.94),
    "Uttarakhand": (30.06, 79.01),
    "West Bengal": (22.98, 87.85),
    "Delhi": (28.70, 77.10),
    "Chandigarh": (30.73, 76.77),
    "Ladakh": (34.15, 77.57),
    "Jammu & Kashmir": (33.77, 76.57),
    "Puducherry": (11.94, 79.80),
}

# Stand-in points for unknown states (rows) and for no selection (view).
DEFAULT_POINT = (20.0, 78.0)
DEFAULT_FOCUS = (22.0, 79.0)
ZOOM_SELECTED, ZOOM_ALL = 6, 4


def official_states(spark: SparkSession) -> DataFrame:
    """37 rows ``(position, state)``; safe to broadcast because the list is fixed."""
    rows = [(i, name) for i, name in enumerate(OFFICIAL_STATES)]
    return F.broadcast(spark.createDataFrame(rows, "position int, state string"))


def state_centroids(spark: SparkSession) -> DataFrame:
    """33 rows ``(state, lat, lon)``; safe to broadcast because the list is fixed."""
    rows = [(name, lat, lon) for name, (lat, lon) in STATE_CENTROIDS.items()]
    return F.broadcast(spark.createDataFrame(rows, "state string, lat double, lon double"))
