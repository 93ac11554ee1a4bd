"""All core queries and their SQL by name."""

from quadrant.plans import areas, features, files, general, network, paths, phrases, ranking, reports, rooms, shapes, spatial, stateful

MODULES = [spatial, shapes, areas, files, reports, rooms, ranking, paths, stateful, features, phrases, network, general]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
