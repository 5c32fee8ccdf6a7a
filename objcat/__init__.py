"""objcat: object inventories, transfer plans and audit trails as Spark tables and streams."""

__version__ = "0.1.0"
