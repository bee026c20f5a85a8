"""The reader's and writer's whole flows, composed from operators."""
