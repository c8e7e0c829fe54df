"""Zones of the registered containment query: the ports, and a ring of water around each of them."""

from wakeline.constants import PORT_ZONES


def scaled(ring: list, factor: float) -> list:
    x, y = (sum(p[i] for p in ring) / len(ring) for i in (0, 1))
    return [(x + factor * (a - x), y + factor * (b - y)) for a, b in ring]


def shapes() -> list[tuple[str, list]]:
    """(name, rings): the second kind has a hole."""
    ports = [(name, [ring]) for name, ring in PORT_ZONES.items()]
    return ports + [(f"around {name}", [scaled(ring, 90.0), scaled(ring, 25.0)]) for name, ring in PORT_ZONES.items()]
