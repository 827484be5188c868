"""DataFrame -> DataFrame operators on trial logs."""
