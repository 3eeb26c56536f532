"""Readers of stored inputs."""
