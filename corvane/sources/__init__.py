"""Sources and sinks; bank has them all."""
