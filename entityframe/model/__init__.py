"""The mapping model: entities, properties, associations and temporal kinds."""

from .mapping import Association, EntityDef, Join, Model, PropertyDef, Source
from .milestoning import BiTemporal, BusinessDate, BusinessDateAndProcessing, Milestoning, Processing

__all__ = ["Association", "BiTemporal", "BusinessDate", "BusinessDateAndProcessing", "EntityDef", "Join", "Milestoning", "Model", "Processing", "PropertyDef", "Source"]
