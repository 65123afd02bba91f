"""Spark jobs for gridded daily panels, event synchronization networks and their inputs."""
