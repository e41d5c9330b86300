"""What runs on the driver and touches no table: paths, settings, protocol, access."""
