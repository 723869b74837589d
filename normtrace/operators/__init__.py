"""Table-to-table operators; every table is keyed by ``norm_id`` (and ``scenario_id``)."""
