"""Changes of single ways and areas as column expressions: nodes of a way, holes of an area, tags of either. Boxes are
computed from the points whenever they are needed, so an edit never leaves one behind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMS = ("tuples", "coords", "arrays")


def append_node(nodes: Column, node: Column) -> Column:
    return F.concat(F.coalesce(nodes, F.slice(F.array(node), 1, 0)), F.array(node))


def remove_node(nodes: Column, node_id: Column) -> Column:
    """Without the first of the nodes (structs with id) that has the id; unchanged if none has."""
    at = F.array_position(F.transform(nodes, lambda n: n["id"]), node_id).cast("int")
    return F.when(at > 0, F.concat(F.slice(nodes, 1, at - 1), F.slice(nodes, at + 1, F.size(nodes)))).otherwise(nodes)


def clear(items: Column) -> Column:
    """None of the items."""
    return F.slice(items, 1, 0)


def set_outer(rings: Column, ring: Column) -> Column:
    """The rings with another outer ring, holes kept."""
    return F.concat(F.array(ring), F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))))


def add_hole(rings: Column, ring: Column) -> Column:
    return F.concat(rings, F.array(ring))


def remove_hole(rings: Column, number: int) -> Column:
    """Without hole ``number``, from 0; unchanged if there is none."""
    return F.when(F.size(rings) > number + 1, F.concat(F.slice(rings, 1, number + 1), F.slice(rings, number + 3, F.size(rings)))).otherwise(rings)


def clear_holes(rings: Column) -> Column:
    return F.slice(rings, 1, 1)


def set_tag(tags: Column, key: str, value: str, blank_keys: bool = False) -> Column:
    """The tags with one more. Keys and values are text and a key is not empty, nor blank unless blank_keys is set, as
    it may be for areas."""
    if not isinstance(key, str) or not isinstance(value, str):
        raise TypeError("key and value of a tag are text")
    if not (key if blank_keys else key.strip()):
        raise ValueError("the key of a tag is empty")
    from wakeline.operators.features import with_tag

    return with_tag(tags, key, F.lit(value))


def remove_tag(tags: Column, key: str) -> Column:
    return F.map_filter(tags, lambda k, _: k != key)


def coordinates(nodes: Column, form: str = "tuples") -> Column:
    """The nodes (structs id, lat, lon) as tuples (id, lat, lon), as coords (lat, lon), or as three arrays."""
    if form == "tuples":
        return F.transform(nodes, lambda n: F.struct(n["id"].alias("id"), n["lat"].alias("lat"), n["lon"].alias("lon")))
    if form == "coords":
        return F.transform(nodes, lambda n: F.struct(n["lat"].alias("lat"), n["lon"].alias("lon")))
    if form == "arrays":
        return F.struct(*[nodes[c].alias(c) for c in ("id", "lat", "lon")])
    raise ValueError(f"form is none of {', '.join(FORMS)}: {form}")
