"""All queries by name."""

from workload import answers, autoencoders, day_sketches, frequents, indexes, knowledge, labeling, maps, models, rule_tables, scoring, stored_topics, streams, topics

_PARTS = [labeling, rule_tables, scoring, day_sketches, frequents, models, autoencoders, topics, stored_topics, knowledge, indexes, maps, answers, streams]

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
