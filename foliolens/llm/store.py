"""Tables written once and read again, in the folder that the cluster shares."""

from foliolens.sources.tables import written

__all__ = ["written"]
