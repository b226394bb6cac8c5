"""Searches over unbounded inputs."""
