"""Neural embeddings and clustering in them, trained on partitions."""
