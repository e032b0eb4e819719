"""Jobs and registered queries."""

from wakeline.plans import files, graphs, learning, tracks

QUERIES = tracks.QUERIES | graphs.QUERIES | learning.QUERIES | files.QUERIES
