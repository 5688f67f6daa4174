"""Operators on graph, agent, trace and metric frames."""
