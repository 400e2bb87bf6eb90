"""Pipeline stages, backlogs and snapshot maintenance."""
